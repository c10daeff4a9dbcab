"""Problem 6: markup left in texts, of the kinds html, markdown, wiki and latex, and its removal.

A text is cut into leaf blocks: every line is cut at its tags, each tag is a block of its own, and every
block knows its ancestor tags.  A linear-chain conditional random field labels the blocks as plain
text, html, markdown, wiki, latex, formula or code.  Its features are the block's own signs, the names of
all its ancestor tags and of its parent, its place on the line, and which kinds of unmistakable signs the document
holds at all, so that a sign of several kinds (``* item``, ``# item``) takes the kind of its neighbours and of the
document.  No rule overrules the model.  Tags are html in wiki text as well, as are comments and entities.
The model is trained on pages labelled by construction (``training_pages``: PAGES pages from a seeded
generator), by gradient ascent on the conditional likelihood, and decoded by Viterbi.

A document has the kinds of the labels of its blocks.  ``clean`` removes the markup and keeps headings
(``# ``), list items (``- ``), code and formulas.

A script, style or pre tag, a code fence, a verbatim environment and a comment hold what follows only if
their end follows too; without it they are a lone tag or line, and the rest of the text is read as any.

Defined cases: null, empty and blank texts have no kind and stay as they are; texts without any sign are
plain; repeated rows count once in kinds and give repeated rows in clean.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.llm.tables import table
from skein.session import ship

KINDS = ("html", "markdown", "wiki", "latex")
LABELS = ("text", *KINDS, "formula", "code")
TEXT, HTML, MARKDOWN, WIKI, LATEX, FORMULA, CODE = range(len(LABELS))
#: Labelled pages that the model is trained on.
PAGES = 800

TAG = re.compile(r"<!--(?:.*?-->)?|</?[A-Za-z][A-Za-z0-9]*(?:\s+[^<>\n]*|/)?/?>|<![A-Za-z][^<>\n]*>", re.S)
TAG_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
WIKI_TAGS = {"ref", "math", "nowiki", "gallery", "references", "blockcode", "syntaxhighlight"}
#: Tags that change what their content means.
HOLDING = {"script", "style", "pre"}
VOID = {"br", "hr", "img", "meta", "link", "input", "wbr", "p", "li", "dt", "dd", "td", "tr", "th", "font"}
COMMANDS = (
    "documentclass|usepackage|title|author|date|maketitle|chapter|(?:sub)*section|(?:sub)?paragraph|part|item|textbf|textit|texttt|textsc|textsf|underline|emph|em|it|bf|sc|tt|rm|sl"
    "|cite[tp]?|ref|eqref|pageref|label|footnote|href|url|noindent|centering|hline|caption|includegraphics|newpage|clearpage|bigskip|medskip|smallskip|vspace|hspace|par|small|large|tableofcontents|bibliography|bibitem|newcommand|input|index"
)
#: Signs by name: pattern, and the kind if no other kind has such signs.
SIGNS: dict[str, tuple[str, int | None]] = {
    "entity": (r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});", HTML),
    "md_heading": (r"^\s{0,3}#{2,6} +\S", MARKDOWN),
    "hash_one": (r"^#+ *\S", None),
    "md_strong": (r"\*\*[^\s*](?:[^*\n]*[^\s*])?\*\*|(?<!\w)__(?!NO|TOC|FORCE)[^\s_](?:[^_\n]*[^\s_])?__(?!\w)", MARKDOWN),
    "star_word": (r"(?<![\w*])\*[^\s*](?:[^*\n]*[^\s*])?\*(?![\w*])", MARKDOWN),
    "md_link": (r"!?\[[^\[\]\n]*\]\((?:[^()\s]+)(?: \"[^\"]*\")?\)|^\[[^\]\n]+\]: +\S|\[\^\w+\]", MARKDOWN),
    "md_code": (r"(?<![`\w])`[^`\n]+`(?!`)", MARKDOWN),
    "md_fence": (r"^\s*(?:```|~~~)", MARKDOWN),
    "md_quote": (r"^\s{0,3}>+ +\S", MARKDOWN),
    "md_table": (r"^\s*\|.*\|\s*$", None),
    "md_rule_row": (r"^\s*\|?\s*:?-{3,}:?\s*\|", MARKDOWN),
    "md_task": (r"^\s*[-*+] +\[[ xX]\] ", MARKDOWN),
    "md_strike": (r"~~\S[^~\n]*~~", MARKDOWN),
    "underline": (r"^(?:={4,}|-{4,})\s*$", None),
    "rule": (r"^\s*(?:-{3}|\*{3}|_{3}|(?:\* ){2,}\*|(?:- ){2,}-)\s*$", None),
    "wiki_heading": (r"^(={2,6}) ?[^=\s](?:.*[^=\s])? ?\1\s*$", WIKI),
    "wiki_link": (r"\[\[[^\[\]\n]+\]\]|\[https?://\S+ [^\]\n]+\]", WIKI),
    "wiki_template": (r"\{\{[^{}\n]*(?:\}\}|$)", WIKI),
    "wiki_quotes": (r"'{2,5}[^'\s](?:[^'\n]|'(?!'))*?'{2,5}", WIKI),
    "wiki_magic": (r"__(?:NO|TOC|FORCE)[A-Z]*__|^#REDIRECT", WIKI),
    "wiki_table": (r"^\{\||^\|-[^|]*$|^\|\}\s*$|^!\s*\S.*!!", WIKI),
    "wiki_row": (r"^\| ?\w+ *= *\S|^\}\}\s*$", None),
    "wiki_define": (r"^; *\S.* : ?\S", WIKI),
    "wiki_indent": (r"^[:;*#]{2,} *\S", None),
    "colon": (r"^:+ *\S", None),
    "star": (r"^\s*[*+] +\S", None),
    "dash": (r"^\s*- +\S", None),
    "number": (r"^\s*\d{1,3}[.)] +\S", None),
    "latex_command": (rf"\\(?:{COMMANDS})(?![A-Za-z])\*?", LATEX),
    "latex_environment": (r"\\(?:begin|end)\{(?!equation|align|gather|multline|eqnarray|displaymath|math\b|cases|[pbvV]?matrix|array|split)[A-Za-z]+\*?\}", LATEX),
    "latex_break": (r"\\\\(?:\[\d+(?:pt|em|ex|cm|mm)\])|\\\\\s*$|\\[%&_#](?=\s|\w)", LATEX),
    "latex_accent": (r"\\[\"'`^~][a-zA-Z{]", LATEX),
    "latex_comment": (r"(?<=\s)% \S", None),
    "latex_quotes": (r"``[^`'\n]+''", None),
    "math_environment": (r"\\(?:begin|end)\{(?:equation|align|gather|multline|eqnarray|displaymath|math|cases|[pbvV]?matrix|array|split)\*?\}", None),
    "math": (r"\$[^$\n]+\$|\\\(.*?\\\)|\\\[|\\\]|\$\$", None),
    "proof": (r"^\s*(?:lemma|theorem|definition|def|example|axiom|instance|intro|apply|by|exact|simp|have|show|qed)\b.*(?::=|:|;|=>|→|\bby\b)|\(\*.*\*\)|^\s*--\s", None),
    "code_line": (r"^\s*(?:def|for|while|if|return|import|from|class|print)\b.*[:=()]|^\s*\w+ *[-+/*]?= *[\w\[\"(]|^\s+\w+\(.*\)\s*$|[;{}]\s*$", None),
    "indent": (r"^(?: {4}|\t)\S", None),
}
PATTERNS = {name: re.compile(p) for name, (p, _) in SIGNS.items()}
SURE = {name: kind for name, (_, kind) in SIGNS.items() if kind is not None}
ANY_SIGN = re.compile(r"<[A-Za-z/!]|&[#A-Za-z]|[#`\\\[{~]|\*\S|\S\*|__|''|^[ \t]*[-*+>|:;!] ?|^={1,}|^-{3}|^_{3}|% |\$", re.M)
#: Signs that a block can have without any of those.
QUIET = ("number", "proof", "code_line", "indent")

#: Tags that features name; all others are "other".
NAMED = (
    "html head title body div span p br hr a b i em strong u s sub sup small font h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th caption pre code tt kbd"
    " blockquote cite img script style noscript nav header footer section article aside main form input button label iframe details summary meta link ref math nowiki gallery".split()
)
FEATURES = ["bias", "tag", "closing", "wiki_tag", "in_wiki_tag", "in_pre", "in_script", "in_tag", "in_fence", "in_template", "in_environment", "in_verbatim", "first", *SIGNS, *(f"doc_{k}" for k in KINDS), *(f"doc_no_{k}" for k in KINDS), *(f"sure_{k}" for k in KINDS)]
#: Signs of several kinds together with the kinds the document surely has.
SHARED = ["hash_one", "md_table", "underline", "rule", "wiki_row", "wiki_indent", "colon", "star", "dash", "number", "latex_comment", "latex_quotes", "indent", "in_template"]
FEATURES += [f"{s}&{k}" for s in SHARED for k in KINDS] + [f"{s}&no_{k}" for s in SHARED for k in KINDS]
FEATURES += [f"{role}:{t}" for role in ("is", "in", "under") for t in [*NAMED, "other"]]
PLACE = {name: k for k, name in enumerate(FEATURES)}


class Block:
    __slots__ = ("text", "line", "ancestors", "tag", "features")

    def __init__(self, text: str, line: int, ancestors: tuple[str, ...], tag: str):
        self.text, self.line, self.ancestors, self.tag, self.features = text, line, ancestors, tag, []


def holding(text: str, tags: list[re.Match]) -> set[int]:
    """Where script, style and pre tags begin whose end is the next tag of their name; tags in Markdown code count as text."""
    out: set[int] = set()
    ended: dict[str, bool] = {}
    for m in reversed(tags):
        found = TAG_NAME.match(m.group())
        name = found.group(1).lower() if found else "!"
        if name not in HOLDING:
            continue
        line = text.rfind("\n", 0, m.start()) + 1
        if text.count("`", line, m.start()) % 2 and text.find("`", m.end(), text.find("\n", m.end()) % (len(text) + 1)) >= 0:
            continue
        if m.group()[1] != "/" and ended.get(name):
            out.add(m.start())
        ended[name] = m.group()[1] == "/"
    return out


def blocks_of(text: str) -> list[Block]:
    """Leaf blocks in order."""
    out: list[Block] = []
    stack: list[str] = []
    line = at = 0

    def plain(part: str) -> None:
        nonlocal line
        for k, piece in enumerate(part.split("\n")):
            if k:
                line += 1
            if piece.strip():
                out.append(Block(piece, line, tuple(stack), ""))

    found_tags = list(TAG.finditer(text)) if "<" in text else []
    held = holding(text, found_tags)
    for m in found_tags:
        plain(text[at : m.start()])
        at = m.end()
        found = TAG_NAME.match(m.group())
        name = found.group(1).lower() if found else "!"
        out.append(Block(m.group(), line, tuple(stack), name))
        line += m.group().count("\n")
        if found and name not in VOID and not m.group().endswith("/>"):
            if m.group()[1] != "/":
                if name not in HOLDING or m.start() in held:
                    stack.append(name)
            elif name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
    plain(text[at:])
    return out


def named(tag: str) -> str:
    return tag if tag in NAMED else "other"


def describe(blocks: list[Block]) -> bool:
    """Fill in the blocks' features; False if no block has a sign."""
    sure: set[int] = set()
    fence = verbatim = False
    template = environment = 0
    signs = False
    last_line = -1
    last_fence = max((k for k, b in enumerate(blocks) if not b.tag and (not k or b.line != blocks[k - 1].line) and PATTERNS["md_fence"].search(b.text)), default=-1)
    last_verbatim = max((k for k, b in enumerate(blocks) if "\\end{verbatim" in b.text or "\\end{lstlisting" in b.text), default=-1)
    for place, b in enumerate(blocks):
        names = ["bias"]
        if b.line != last_line:
            names.append("first")
        if b.tag:
            signs = True
            sure.add(HTML)
            names += ["tag", f"is:{named(b.tag)}"]
            if b.tag in WIKI_TAGS:
                names.append("wiki_tag")
            if b.text[1] == "/":
                names.append("closing")
        else:
            code = fence or verbatim or "pre" in b.ancestors or "script" in b.ancestors or "style" in b.ancestors
            at_start = b.line != last_line
            own: set[int] = set()
            quiet = not ANY_SIGN.search(b.text)
            for name, pattern in PATTERNS.items():
                if quiet and name not in QUIET:
                    continue
                if code and name not in ("md_fence", "latex_environment", "code_line", "entity"):
                    continue
                if not at_start and pattern.pattern[0] == "^":
                    continue
                if pattern.search(b.text):
                    names.append(name)
                    if name in SURE:
                        sure.add(SURE[name])
                        own.add(SURE[name])
                    if name not in ("proof", "code_line"):
                        signs = True
            names += [f"sure_{KINDS[k - 1]}" for k in own]
            if "md_fence" in names:
                fence = not fence and place < last_fence
            elif fence:
                names.append("in_fence")
            if template > 0:
                names.append("in_template")
            template = max(0, template + b.text.count("{{") - b.text.count("}}"))
            if "\\begin{" in b.text and "latex_environment" in names:
                environment += 1
                verbatim = verbatim or (place <= last_verbatim and ("verbatim" in b.text or "lstlisting" in b.text))
            if verbatim:
                names.append("in_verbatim")
            if "\\end{" in b.text and "latex_environment" in names:
                environment = max(0, environment - 1)
                verbatim = False
            elif environment:
                names.append("in_environment")
        last_line = b.line
        if b.ancestors:
            inner = set(b.ancestors)
            names += [f"in:{t}" for t in {named(a) for a in inner}]
            names.append(f"under:{named(b.ancestors[-1])}")
            names.append("in_wiki_tag" if inner & WIKI_TAGS else "in_tag")
            if inner & {"pre", "code"}:
                names.append("in_pre")
            if inner & {"script", "style"}:
                names.append("in_script")
        b.features = names
    kinds = [KINDS[k - 1] for k in sure]
    shared = set(SHARED)
    for b in blocks:
        names = b.features + [f"doc_{k}" if k in kinds else f"doc_no_{k}" for k in KINDS]
        names += [f"{s}&{k if k in kinds else 'no_' + k}" for s in b.features if s in shared for k in KINDS]
        b.features = [PLACE[n] for n in names]
    return signs


class Chain:
    """The conditional random field: weights of the features by label, and of neighbouring labels."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def decode(self, blocks: list[Block]) -> list[int]:
        scores = np.array([self.emit[b.features].sum(axis=0) for b in blocks])
        best = scores[0]
        back = []
        for row in scores[1:]:
            paths = best[:, None] + self.move
            at = paths.argmax(axis=0)
            back.append(at)
            best = paths[at, np.arange(len(LABELS))] + row
        out = [int(best.argmax())]
        for at in reversed(back):
            out.append(int(at[out[-1]]))
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, rate: float = 0.1, prior: float = 0.02) -> Chain:
    """Gradient ascent (Adam) on the conditional log-likelihood, all pages at once."""
    pages = sorted(pages, key=lambda page: -len(page[0]))
    n, steps, many = len(pages), len(pages[0][0]), len(LABELS)
    x = np.zeros((sum(len(p) for p, _ in pages), len(FEATURES)))  # one row a block, page by page
    gold = np.zeros((n, steps), np.int64)
    live = np.zeros((n, steps))
    row = 0
    for i, (page, labels) in enumerate(pages):
        for t, (b, y) in enumerate(zip(page, labels)):
            x[row, b.features] = 1
            gold[i, t], live[i, t] = y, 1
            row += 1
    there = live > 0
    longer = there.sum(axis=0)  # pages with a block at each place: the first ones, as the longest come first
    one = np.eye(many)
    observed_emit = x.T @ one[gold[there]]
    pairs = live[:, 1:]
    observed_move = (one[gold[:, :-1]] * pairs[:, :, None]).reshape(-1, many).T @ one[gold[:, 1:]].reshape(-1, many)
    emit, move = np.zeros((len(FEATURES), many)), np.zeros((many, many))
    state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    for turn in range(1, rounds + 1):
        score = np.zeros((n, steps, many))
        score[there] = x @ emit
        here = np.exp(score - score.max(axis=2, keepdims=True))
        step = np.exp(move - move.max())
        ahead, behind = np.ones((n, steps, many)), np.ones((n, steps, many))  # scaled to sum to 1 at every place
        ahead[:, 0] = here[:, 0] / here[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, steps):
            k = longer[t]
            now = (ahead[:k, t - 1] @ step) * here[:k, t]
            ahead[:k, t] = now / now.sum(axis=1, keepdims=True)
        expect_move = np.zeros_like(move)
        for t in range(steps - 2, -1, -1):
            k = longer[t + 1]
            right = here[:k, t + 1] * behind[:k, t + 1]
            now = right @ step.T
            behind[:k, t] = now / now.sum(axis=1, keepdims=True)
            norm = ((ahead[:k, t] @ step) * right).sum(axis=1, keepdims=True)
            expect_move += step * ((ahead[:k, t] / norm).T @ right)
        chance = ahead * behind
        chance *= live[:, :, None] / chance.sum(axis=2, keepdims=True)
        expect_emit = x.T @ chance[there]
        for k, (weights, gradient) in enumerate(((emit, observed_emit - expect_emit), (move, observed_move - expect_move))):
            gradient = gradient / n - prior * weights / 10
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * gradient
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * gradient**2
            weights += rate * (state[2 * k] / (1 - 0.9**turn)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**turn)) + 1e-6)
    return Chain(emit, move)


def training_pages(n: int, seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """Pages whose blocks are labelled by the way they were made."""
    r = random.Random(seed)
    vocabulary = "the of and river theory stone value holds under every large finite garden morning unless because number shape letter bridge walks 12 47 x y=3 a<b".split()

    def words(low: int = 3, high: int = 14) -> str:
        return " ".join(r.choice(vocabulary) for _ in range(r.randint(low, high)))

    def decorated(*forms: str) -> str:
        return f"{words()} {r.choice(forms).format(words(1, 3))} {words()}."

    formulas = ["$x^{2} + \\frac{1}{3}$", "\\(\\sqrt{2} \\le y\\)", "$$\\int_0^{3} t\\,dt$$", "\\[ \\sum_{k=1}^{9} k \\]"]
    code = ["def f(n):", "    total = 0", "    for i in range(9):", "        total += n * i", "    return total", "x = [1, 2]", "print(sum(x))", "while n > 3:", "    n = n // 2"]
    proofs = ["lemma a_12 (s : Set) : 1 ∈ s := by", "  intro h; simp [h, rule_3]", "definition g := fun x => x^2 + 1", "  (* holds *)", "  apply step; exact h  -- done", "theorem b {n : Nat} : n < n + 1 := by"]

    def markdown() -> list[tuple[str, int]]:
        return r.choice([
            lambda: [("#" * r.randint(1, 6) + " " + words(), MARKDOWN)], lambda: [(words(), TEXT), ("=" * r.randint(5, 20), MARKDOWN)],
            lambda: [(r.choice("*-+") + " " + words(), MARKDOWN) for _ in range(r.randint(2, 5))], lambda: [(f"{k}. {words()}", MARKDOWN) for k in range(1, 4)],
            lambda: [(decorated("**{}**", "*{}*", "__{}__", "`{}`", "[{}](https://a.example/p)", "~~{}~~", "![{}](i.png)"), MARKDOWN)], lambda: [(words() + ". See [" + words(1, 2) + "](https://a.example/p). " + words(), MARKDOWN)],
            lambda: [("> " + words(), MARKDOWN)], lambda: [(r.choice(["---", "***", "----"]), MARKDOWN)], lambda: [(r.choice(formulas), FORMULA), ("#" * r.randint(1, 4) + " " + words(), MARKDOWN)], lambda: [("```" + r.choice(["", "python", "text"]), MARKDOWN), *((c, CODE) for c in r.sample(code, 3)), ("```", MARKDOWN)],
            lambda: [("| a | b |", MARKDOWN), ("|---|---|", MARKDOWN), ("| 1 | 2 |", MARKDOWN)], lambda: [("- [x] " + words(), MARKDOWN)], lambda: [(words(), TEXT)], lambda: [(r.choice(formulas), FORMULA)],
        ])()

    def wiki() -> list[tuple[str, int]]:
        return r.choice([
            lambda: [("=" * (k := r.randint(2, 4)) + " " + words() + " " + "=" * k, WIKI)], lambda: [("{{Infobox x", WIKI), ("| name = " + words(1, 3), WIKI), ("| rank = 3", WIKI), ("}}", WIKI)],
            lambda: [(r.choice(["*", "#", "**", ":", "##", "*#"]) + " " + words(), WIKI) for _ in range(r.randint(2, 5))], lambda: [(decorated("[[{}]]", "[[A page|{}]]", "'''{}'''", "''{}''", "{{{{cite|{}}}}}"), WIKI)],
            lambda: [("{| class=wikitable", WIKI), ("|-", WIKI), ("| 1 || 2", WIKI), ("|}", WIKI)], lambda: [("[[Category:" + words(1, 3) + "]]", WIKI)], lambda: [("__NOTOC__", WIKI)], lambda: [("----", WIKI)], lambda: [("; " + words(1, 2) + " : " + words(1, 3), WIKI)],
            lambda: [(words() + ".<ref name=r1>" + words(1, 4) + "</ref> <math>x^2 + \\frac{1}{3}</math>", -HTML)], lambda: [(words() + r.choice(["<br/>", "&nbsp;", "<!-- hidden -->", "<small>x</small>", "<references />"]), -HTML)], lambda: [(words(), TEXT)],
        ])()

    def latex() -> list[tuple[str, int]]:
        return r.choice([
            lambda: [("\\" + r.choice(["section", "subsection*", "paragraph", "title"]) + "{" + words(1, 4) + "}", LATEX)], lambda: [("\\begin{itemize}", LATEX), *(("\\item " + words(), LATEX) for _ in range(3)), ("\\end{itemize}", LATEX)],
            lambda: [(decorated("\\textbf{{{}}}", "\\emph{{{}}}", "{{\\it {}}}", "\\footnote{{{}}}", "~\\cite{{a1}} {}"), LATEX)], lambda: [("\\documentclass[10pt]{article}", LATEX), ("\\begin{document} % draft", LATEX)], lambda: [(r.choice(formulas), FORMULA)],
            lambda: [("\\begin{verbatim}", LATEX), *((c, CODE) for c in r.sample(code, 3)), ("\\end{verbatim}", LATEX)], lambda: [(words() + ".\\\\[2pt]\\noindent " + words(), LATEX)], lambda: [(words(), TEXT)],
        ])()

    def page_html() -> list[tuple[str, int]]:
        return r.choice([
            lambda: [(f"<p>{words()}</p>", -HTML)], lambda: [("<ul>", -HTML), (f"<li>{words()}", -HTML), (f"<li>{words()}</li>", -HTML), ("</ul>", -HTML)], lambda: [(f"<h2 class=\"s\">{words()}</h2>", -HTML)],
            lambda: [(f"{words()} &lt; 3 &amp; {words()}&nbsp;{words()}", HTML)], lambda: [("<!-- nav 3 -->", -HTML)], lambda: [(f"{words()} <b>{words(1, 2)}</b> {words()}<br/>", -HTML)], lambda: [("<pre><code>x = 3", -HTML), ("y = x // 2</code></pre>", -HTML)], lambda: [(words(), TEXT)],
            lambda: [(f"<div class=\"{words(1, 1)}\"><{(t := r.choice(NAMED))}>{words(1, 5)}</{t}> <a href=\"/p\">{words(1, 2)}</a>", -HTML), (f"{r.choice('*-')} {words()}", TEXT), ("</div>", -HTML)],
            lambda: [("<table><tr><th>A<td>B", -HTML), (f"<tr><td>{words(1, 3)}</td><td>{r.choice(formulas)}</td></tr></table>", -HTML)],
            lambda: [("<!DOCTYPE html><html><head><title>" + words(1, 4) + "</title>", -HTML), ("<script>var a = 3;", -HTML), ("if (a > 2) { f(a); }</script></head><body>", -HTML)],
        ])()

    def plain() -> list[tuple[str, int]]:
        return r.choice([lambda: [(words(), TEXT)], lambda: [(f"{words()} {r.choice(formulas)} {words()}", FORMULA)], lambda: [(p, CODE) for p in r.sample(proofs, 2)], lambda: [(c, CODE) for c in r.sample(code, 2)], lambda: [(f"{r.choice('*-')} {words()}", TEXT) for _ in range(2)], lambda: [(f"{k}. {words()}", TEXT) for k in (1, 2)]])()

    pages = []
    while len(pages) < n:
        make = r.choice([markdown, wiki, latex, page_html, plain])
        parts: list[tuple[str, int]] = []
        for _ in range(r.randint(1, 8)):
            parts += make()
            if make is markdown and r.random() < 0.05:
                parts.append((r.choice(["<details><summary>a</summary>", "<img src=\"a.png\">", "</details>"]), -HTML))
        page = blocks_of("\n".join(p for p, _ in parts))
        describe(page)
        made = dict(enumerate(y for _, y in parts))
        labels = []
        for b in page:
            y = made[b.line]
            if y < 0:  # tags have the kind; what stands between them is text, code or a formula
                inner = set(b.ancestors)
                y = -y if b.tag or PATTERNS["entity"].search(b.text) else CODE if inner & {"pre", "script", "style"} else FORMULA if "math" in inner or b.text.strip() in formulas else TEXT
            labels.append(y)
        if page:
            pages.append((page, labels))
    return pages


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    chain = train(training_pages(PAGES))
    return chain.emit, chain.move


def label(text: str, chain: Chain) -> list[tuple[Block, int]]:
    """Blocks of a text with their labels; none if it has no sign of markup."""
    if not ANY_SIGN.search(text):
        return []
    blocks = blocks_of(text)
    if not blocks or not describe(blocks):
        return []
    return list(zip(blocks, chain.decode(blocks)))


HEADING = re.compile(r"^\s*(?:#{1,6} +(.*?)#*|={1,6} ?(.*?) ?={1,6}|.*?\\(?:(?:sub)*section|(?:sub)?paragraph|chapter|title)\*?\{(.*?)\}.*)\s*$")
ITEM = re.compile(r"^\s*(?:[*+#:;-]+|\d{1,3}[.)]|\\item)\s+")
INLINE = [
    (re.compile(r"!?\[([^\[\]]*)\]\([^()]*\)"), r"\1"), (re.compile(r"\[\[(?:Category|File|Image):[^\]]*\]\]"), ""), (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"\{\{[^{}]*\}\}"), ""), (re.compile(r"'{2,5}"), ""), (re.compile(r"\*\*|~~"), ""), (re.compile(r"(?<!\w)__(.+?)__(?!\w)"), r"\1"), (re.compile(r"(?<![\w*])\*(\S(?:[^*]*\S)?)\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<!`)`([^`]+)`(?!`)"), r"\1"), (re.compile(r"~?\\(?:cite[tp]?|label|ref)\{[^{}]*\}"), ""), (re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]]*\])?|\\(?:documentclass|usepackage)(?:\[[^\]]*\])?\{[^{}]*\}|\\(?:maketitle|noindent|hline|centering)\b"), ""),
    (re.compile(r"\\(?:textbf|textit|texttt|emph|footnote|underline|textsc)\{([^{}]*)\}"), r"\1"), (re.compile(r"\{\\(?:it|bf|sc|em|tt) ([^{}]*)\}"), r"\1"), (re.compile(r"\\\\(?:\[[^\]]*\])?"), " "), (re.compile(r"(?:^|(?<=\s))% .*$"), ""),
]


def strip_markup(text: str, labelled: list[tuple[Block, int]]) -> str:
    """The text without markup: headings as ``# ``, items as ``- ``, code and formulas as they are."""
    if not labelled:
        return text
    lines: dict[int, str] = {}
    total = text.count("\n") + 1
    for block, y in labelled:
        had = lines.get(block.line, "")
        piece = block.text
        if block.tag:
            if y in (HTML, WIKI):
                if piece.startswith("<!"):
                    piece = ""
                elif re.match(r"<h[1-6]\b", piece, re.I):
                    piece = "# "
                elif block.tag in ("li", "dd", "dt") and piece[1] != "/":
                    piece = ("\n" if had.strip() else "") + "- "
                elif block.tag in ("br", "p", "div", "tr"):
                    piece = "\n" if had.strip() else ""
                else:
                    piece = " " if block.tag in ("td", "th") else ""
        elif "script" in block.ancestors or "style" in block.ancestors:
            piece = ""
        elif y == CODE or "pre" in block.ancestors:
            piece = html.unescape(piece) if "pre" in block.ancestors else piece
        else:
            if "&" in piece and y != FORMULA:
                piece = html.unescape(piece)
            if y in (MARKDOWN, WIKI, LATEX):
                head = HEADING.match(piece)
                title = next((g for g in head.groups() if g), "") if head else ""
                item = ITEM.match(piece) if not head or (y == WIKI and piece.lstrip().startswith("#")) else None
                if item:
                    piece, mark = piece[item.end() :], "- "
                elif title:
                    piece, mark = title, "# "
                else:
                    mark = ""
                    if re.fullmatch(r"\s*(?:```\w*|~~~\w*|[-=|: ]{3,}|\{\|.*|\|[-}].*|\{\{[^{}]*|\}\}|__[A-Z]+__)\s*", piece):
                        piece = ""
                for pattern, to in INLINE:
                    piece = pattern.sub(to, piece)
                piece = mark + piece.strip() if mark else piece
        lines[block.line] = had + piece
    out = "\n".join(lines.get(k, "").rstrip() for k in range(total))
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def find_batches(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(*weights)
        for batch in batches:
            docs, kinds = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = {y for _, y in label(text, chain)} if text else set()
                for y in sorted(found & {HTML, MARKDOWN, WIKI, LATEX}):
                    docs.append(doc)
                    kinds.append(LABELS[y])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(kinds, pa.string())], ["doc_id", "kind"])

    return run


def clean_batches(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(*weights)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            cleaned = [strip_markup(t, label(t, chain)) if t else t for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cleaned, pa.string())], ["doc_id", "text"])

    return run


def markup_kinds(documents: DataFrame) -> DataFrame:
    """documents: doc_id BIGINT, text STRING. Returns doc_id, kind."""
    ship(documents.sparkSession)
    return documents.where("text is not null").mapInArrow(find_batches(model()), "doc_id bigint, kind string").distinct()


def clean(documents: DataFrame) -> DataFrame:
    """doc_id, text without markup."""
    ship(documents.sparkSession)
    return documents.mapInArrow(clean_batches(model()), "doc_id bigint, text string")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_kinds(table(spark, sf_dir, "documents", "doc_id", "text").where("doc_id is not null"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents", "doc_id", "text"))
