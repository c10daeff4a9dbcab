"""Problems 4, 6, 8 and 10: scans, markup, tokens, sentences."""

import random
import time

import numpy as np
import pytest

from skein.llm import p04_scan as P4
from skein.llm import p06_markup as P6
from skein.llm import p08_encode as P8
from skein.llm import p10_sentences as P10

WORDS = {w: 50 for w in "the lattice of every boundary is bounded by a smooth gradient and this measurable basis holds first values for all left-hand left hand modern corner circumference proceedings society".split()}


def lines_of(text):
    page, broken, misread = P4.classify(text, P4.Vocabulary(WORDS))
    return {i + 1 for i in page.furniture}, {i + 1 for i in broken}, {i + 1 for i in misread}


def test_scan_furniture():
    body = ["the lattice of every boundary is bounded by", "a smooth gradient and this measurable basis", "holds for all the values of every lattice by", "the boundary and a gradient of this basis is"]
    text = "\n".join(["Proceedings of the Society", *body, "~ 21 ~", *body, "Proceedings of the Society", *body[:2], "~ 22 ~", *body, "is all.", "748", "", "The lattice is bounded.", "(5.16)"])
    furniture, broken, misread = lines_of(text)
    assert furniture == {1, 6, 11, 14} and not broken and not misread
    assert lines_of("C H A P T E R     5 0 5\nthe lattice")[0] == {1}
    assert lines_of("243   Proceedings of the Society\nthe lattice")[0] == {1}
    assert lines_of("the lattice of every\nxvii\nboundary is bounded")[0] == {2}


def test_scan_header_in_a_long_scan():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 9)))
    lines = []
    for i in range(250):
        lines += [" ".join(["the", *(word() for _ in range(8))]), f"{word().title()} {word()} {word()}", ""]
    for place, header in ((301, "Proceedings 7: of the Society"), (601, "Proceedlngs 7: of the Society")):
        lines[place : place + 1] = ["the lattice of every boundary is bounded by a smooth gradient and", header, "the lattice goes on"]
    text = "\n".join(lines)
    headers = {i + 1 for i, line in enumerate(lines) if line.startswith("Proceed")}
    assert len(headers) == 2 and headers <= lines_of(text)[0]


def test_near_equal_keys_equal_brute_force():
    r = random.Random(6)
    keys = {"", "a", "ab", "abc", "abcd", "ab c"}
    for _ in range(500):
        k = r.choice(sorted(keys)) if r.random() < 0.5 else "".join(r.choice("aabcdef gh") for _ in range(r.choice([3, 6, 7, 10, 20, 40, 80])))
        for _ in range(r.randint(0, 1 + len(k) // 6)):
            at = r.randrange(len(k) + 1)
            k = k[:at] + r.choice(["", r.choice("abcdef")]) + k[at + r.randint(0, 1) :]
        keys.add(k)
    keys = sorted(keys)
    want = {k for k in keys if any(o != k and abs(len(o) - len(k)) <= 2 and P4.SequenceMatcher(None, o, k).ratio() > 0.85 for o in keys)}
    assert P4.near_equal(keys) == want and 50 < len(want) < len(keys)


def test_scan_words():
    assert lines_of("the lat‐\ntice is")[1] == {1}
    assert lines_of("the lat-\ntice is")[1] == {1}
    assert lines_of("the left-\nhand is")[1] == set()
    assert lines_of("the lat-")[1] == set()
    assert lines_of("the lat-\n~ 3 ~\ntice is")[1] == {1}
    for word in ("ba5is", "boundecl", "ﬁrst", "ſmooth", "latt�ce", "modem"):
        assert lines_of(f"the {word} is")[2] == {1}, word
    for word in ("x_3", "75m", "modern", "corner", "Unknownname"):
        assert lines_of(f"the {word} is")[2] == set(), word
    assert lines_of("the circum-\nferen¢e of".replace("¢", "c"))[2] == set()
    assert lines_of("the circum-\nfer3nce of")[2] == {2}


def test_repair(spark):
    vocabulary = P4.Vocabulary(WORDS)
    text = "PROCEEDINGS OF THE SOCIETY\nthe lat-\ntice of every ba5is\nis bounded by the left-\nhand\n~ 3 ~\ngradient.\n\nthe ﬁrst"
    assert P4.repair_text(text, vocabulary) == "the lattice of every basis is bounded by the left-hand gradient.\n\nthe first"
    assert P4.repair_text("\n \n", vocabulary) == ""
    assert P4.repair_text("the lat-\n\n~ 3 ~\n\ntice is", vocabulary) == "the lattice is"
    docs = spark.createDataFrame([("the the lattice lattice once",), (None,), ("",)], "text string")
    assert P4.vocabulary_of(docs) == {"the": 2, "lattice": 2}


@pytest.fixture(scope="module")
def chain():
    return P6.Chain(*P6.model())


def kinds(text, chain):
    return {P6.LABELS[y] for _, y in P6.label(text, chain)} & set(P6.KINDS)


def test_markup_model_on_new_pages(chain):
    right = total = 0
    for page, labels in P6.training_pages(150, seed=12345):
        got = chain.decode(page)
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right >= 0.95 * total


@pytest.mark.parametrize(
    "text,want",
    [
        ("<p>One <b>bold</b> word.</p>", {"html"}), ("A &amp; B stand here.", {"html"}), ("## A title\n\nSome **bold** words.\n\n- item one\n- item two", {"markdown"}), ("See [this](https://a.example/p) for more.", {"markdown"}),
        ("== A title ==\n\nSome '''bold''' words and a [[link]].\n* item one\n* item two", {"wiki"}), ("== A title ==\nText.<ref name=a>note</ref> <math>x^2</math> [[x]]", {"html", "wiki"}), ("\\section{A title}\nSome \\emph{words}.\n\\begin{itemize}\n\\item one\n\\end{itemize}", {"latex"}),
        ("If $x^2 + \\frac{1}{3} = y$ then \\(a < b\\) holds.", set()), ("lemma a_1 (s : Set) : 1 ∈ s := by\n  intro h; simp [h, rule]\n  (* holds *)", set()), ("Plain words, 90 < c and y_2 * y_7 = 3.", set()), (" ", set()), ("- a dash\n- and another", set()),
    ],
)
def test_markup_kinds(chain, text, want):
    assert kinds(text, chain) == want


def test_markup_clean(chain, spark):
    clean = lambda t: P6.strip_markup(t, P6.label(t, chain))
    assert clean("## A title\n\nSome **bold** words, [here](https://a.example/p).\n\n- one\n- two\n\n$$x^2$$") == "# A title\n\nSome bold words, here.\n\n- one\n- two\n\n$$x^2$$"
    assert clean("<h2>T</h2>\n<ul>\n<li>one</li>\n<li>two &lt; 3</li>\n</ul>") == "# T\n\n- one\n- two < 3"
    assert clean("no sign at all") == "no sign at all"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<b>x</b>"), (3, "<b>x</b>")], "doc_id bigint, text string")
    assert sorted((r[0], r[1] or "") for r in P6.clean(df).collect()) == [(1, ""), (2, ""), (3, "x"), (3, "x")]
    assert [tuple(r) for r in P6.markup_kinds(df).collect()] == [(3, "html")]
    assert len(kinds("word <b>x</b> " * 3000, chain)) == 1


@pytest.mark.parametrize("opener", ["Use the `<script>` tag.", "Use the <style> tag.", "A lone <pre> stands here.", "```", "A lone <!-- stands here.", "Use `<script>` first.\n\nThe end is `</script>` then.", "Use <script> first.\n\n<script>x = 1</script>"])
def test_markup_behind_an_unclosed_opener(chain, opener):
    rest = "## A title\n\nSome **bold** words, [here](https://a.example/p).\n\n- one\n- two"
    text = f"{opener}\n\n{rest}"
    assert "markdown" in kinds(text, chain)
    cleaned = P6.strip_markup(text, P6.label(text, chain))
    assert cleaned.endswith("# A title\n\nSome bold words, here.\n\n- one\n- two")
    assert "The end is" not in opener or "The end is" in cleaned


def test_markup_of_closed_openers(chain):
    clean = lambda t: P6.strip_markup(t, P6.label(t, chain))
    assert clean("<p>One</p>\n<script>\nx = 1;\n</script>\n<!-- no\nno -->\n<p>Two</p>") == "One\n\nTwo"


@pytest.fixture(scope="module")
def encoder():
    return P8.Encoder("byte_bpe_50k")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{P8.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_encoding_is_that_of_the_library(encoder, reference):
    r = random.Random(8)
    alphabet = list("abc xyz  \n\t'.,!0129éß中文字กขदে\u00a0\u3000🙂") + ["'s", "'ll", "\r\n", "the ", "<|endoftext|>", "\x00", "\ud800"[:0], "İ"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(600)]
    texts += ["it's we'll 's  's\n's 'tis !'s", "  a  \n\n b \t", "a" * 3000 + " " + "xyz" * 900, "", " ", "'", "中" * 500]
    ids, counts = encoder.encode(texts)
    at = 0
    for text, n, e in zip(texts, counts, reference.encode_batch(texts, add_special_tokens=False)):
        assert ids[at : at + n].tolist() == e.ids, repr(text)
        at += n


def contracted(word, vocabulary):
    """One merge at a time, the leftmost of the least rank."""
    ranks = {(a, b): (k, c) for k, (a, b, c) in enumerate(zip(*(vocabulary.merges[x].to_pylist() for x in ("l", "r", "result"))))}
    tok = [vocabulary.id[bytes([b])] for b in word]
    while True:
        found = min(((ranks[p][0], i) for i, p in enumerate(zip(tok, tok[1:])) if p in ranks), default=None)
        if found is None:
            return tok
        i = found[1]
        tok[i : i + 2] = [ranks[tok[i], tok[i + 1]][1]]


def test_every_token_is_what_its_merges_make(encoder):
    tokens = list(encoder.vocabulary.id)
    assert encoder.contract(tokens) == [[i] for i in encoder.vocabulary.id.values()]


def test_query_contracts_as_one_merge_at_a_time(encoder):
    r = random.Random(1)
    words = [bytes(r.randrange(256) for _ in range(r.randint(1, 40))) for _ in range(100)] + [b"ananasbananabandana" * 5, b"aaaaaaa", b"aaaabaaa", b"\xe4\xb8\xad" * 41]
    words += ["".join(r.choice("aab") for _ in range(r.randint(1, 60))).encode() for _ in range(50)]
    assert encoder.contract(words) == [contracted(w, encoder.vocabulary) for w in words]


def test_long_runs_of_letters_and_signs(encoder, reference):
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(100)) for _ in range(3000)), "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(2000)), "x" * 200_000, "中" * 100_000]
    texts += ["。".join("".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(130)) for _ in range(400))]
    ids, counts = encoder.encode(texts)
    assert ids.tolist() == [i for e in reference.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def test_words_of_equal_first_hash(encoder, monkeypatch):
    texts = ["one two", "three four two", "five"]
    want = [encoder.encode([t])[0].tolist() for t in texts]
    other = P8.Encoder("byte_bpe_50k")
    real = np.unique
    monkeypatch.setattr(P8.np, "unique", lambda x, **k: real(np.zeros_like(x), **k))
    ids, counts = other.encode(texts)
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_encoding_of_nothing_and_forgetting(spark, encoder, monkeypatch):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id bigint, text string")
    assert sorted((r[0], r[1]) for r in P8.encode(df).collect()) == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    assert P8.encode(df.limit(0)).count() == 0
    before = encoder.encode(["one two three four"])[0].tolist()
    monkeypatch.setattr(P8, "HELD", 0)
    assert encoder.encode(["one two five three four"])[0].tolist()[:2] == before[:2]
    assert encoder.encode(["one two three four"])[0].tolist() == before


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Roy and Prof. Lee met at 5 a.m. in town.", "They saw 3.5 cats, e.g. two, etc.", "Then it ended."], ["Does it hold?", "\"Is it so?\" asked Roy before it was done.", "\"It holds.\"", "(Only if 46 < b.)", "He shouted \"It ends!\" and left."],
        ["The value 5! is large.", "See Fig. 3 and Eq. (4) for A. V. Roy.", "The map ... or rather the net ... ends."], ["Im 66. Schritt ist es z. B. am 127. März so, usw.", "Ohne Zahlen geht es nicht.", "„Ist es so?“, fragte er.", "Er rief: „Es ist so!“"],
        ["Quel beau jour !", "« Pourquoi le reste ? » demanda Roy.", "Voir fig. 5, p. ex. la limite.", "« C'est fini ! » cria-t-il."], ["¡Qué bien!", "¿Es único?", "—¿Es así? —dijo Ana.", "El Dr. Roy y la Sra. Lee vieron la pág. 5."], ["dr. roy saw 3.5 cats at 5 a.m. in town, etc.", "the value 5! is large (it grows!) here.", "\"is it so?\" asked roy.", "im 66. schritt ist es so."], ["THE VALUE 5! IS LARGE.", "SEE FIG. 3 AND PROF. LEE."], ["Предел, т. е. число, мал.", "«Да!» — сказал Иван.", "Так и т. д.", "См. рис. 5.", "Проф. Иванов прав."],
    ],
)
def test_sentences(parts):
    text = " ".join(parts)
    ends, at = [], 0
    for p in parts:
        at = text.index(p, at) + len(p)
        ends.append(at)
    assert P10.sentence_ends(text) == ends


def test_sentence_with_many_inner_marks():
    names = ", ".join(f"{'ABCDFJK'[i % 7]}. {'CDFJKLRT'[i % 8]}. Smith" for i in range(40))
    for text in (f"The list of authors is {names} and others.", "See " + "Fig. 1, p. 2, z. B. " * 100 + "and so on."):
        assert P10.sentence_ends(text + " Then it ended.") == [len(text), len(text) + 15]


def test_spans_equal_brute_force():
    r = random.Random(10)
    for k in range(150):
        n = r.randint(1, 150)
        ends = sorted(r.sample(range(1, r.choice([400, 3000, 40000])), n))
        scores = [r.choice([-9.0, -4.0, -2.0, -2.0, 0.5, 4.5, r.uniform(-3, 3), 6.5 if k % 3 == 0 else -1.0]) for _ in range(n - 1)] + [20.0]
        at = [0]
        for _ in range(n):
            at.append(at[-1] + r.choice([0, 0, 0, 1, -1]))
        cost = None if k % 4 == 0 else (lambda i, j: 1.5 * abs(at[j + 1] - at[i + 1]) + 2.0 * ((at[j + 1] - at[i + 1]) % 2))
        best = {-1: 0.0}
        for j in range(n):
            least = max([i for i in range(j) if scores[i] >= 6.0], default=-1)
            value = {i: P10.length(ends[j] - (ends[i] if i >= 0 else 0)) + best[i] - (cost(i, j) if cost else 0.0) for i in range(least, j)}
            best[j] = max(value.values()) + scores[j]
        total, last = 0.0, -1
        for end in P10.choose(0, ends, scores, cost):
            j = ends.index(end)
            total += P10.length(end - (ends[last] if last >= 0 else 0)) - (cost(last, j) if cost else 0.0) + scores[j]
            last = j
        assert last == n - 1 and abs(total - best[n - 1]) < 1e-6


@pytest.mark.parametrize("parts", [["经过3步，结束。", "他说：“好！”然后走了。", "多好啊！"], ["「はい。」と言った。", "終わりだ。"], ["ค่าคือ 2.5 ไม่ใช่ 3.5 เสมอ", " หลังจาก 3 ขั้นตอน"], ["यह सतत है।", " क्या यह सतत है?", " डॉ. राम ने कहा।"], ["هل هو كذلك؟", " قيمة المتجه هي 3.5 دائما."]])
def test_sentences_of_other_scripts(parts):
    text, ends = "".join(parts), []
    for p in parts:
        ends.append((ends[-1] if ends else 0) + len(p))
    assert P10.sentence_ends(text) == ends


def test_sentence_edges(spark):
    assert P10.sentence_ends("") == [] and P10.sentence_ends(" \n\n ") == []
    assert P10.sentence_ends("A heading\n\nOne line\nthat goes on. Next\n\n") == [9, 33, 38]
    assert len(P10.sentence_ends("It ends here. " * 3000)) == 3000
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, " "), (1, "A b. C d.")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in P10.sentences(df).collect()) == sorted([(1, 0, 1, 4), (1, 1, 6, 9)] * 2)


def test_many_number_lines_take_linear_time():
    took = []
    for n in (4_000, 8_000):
        text = "\n".join(f"{k % 977}\nsome words of the body stand here and go on" for k in range(n))
        began = time.perf_counter()
        P4.Page(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 3.5 * took[0] + 0.3


def test_vocabulary_keeps_the_most_frequent_words(spark, monkeypatch):
    texts = spark.createDataFrame([(" ".join(f"w{chr(97 + k)}" for k in range(26) for _ in range(k + 1)),)], "text string")
    assert set(P4.vocabulary_of(texts)) == {f"w{chr(97 + k)}" for k in range(1, 26)}
    monkeypatch.setattr(P4, "WORDS", 5)
    assert set(P4.vocabulary_of(texts)) == {f"w{chr(97 + k)}" for k in range(21, 26)}
    assert P4.vocabulary_of(texts.limit(0)) == {}


def test_replacement_characters_of_other_scripts():
    vocabulary = P4.Vocabulary({"слово": 3, "θέμα": 3})
    assert vocabulary.meant("сло\ufffdо") == "слово" and vocabulary.meant("θέ\ufffdα") == "θέμα"
