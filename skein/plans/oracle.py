"""The same results as SQL over the same tables, for DuckDB."""

from __future__ import annotations

from skein.functions import classify as C
from skein.functions import quality as Q
from skein.functions.text import BLANK
from skein.operators.curriculum import PLACES, PREFIXES, PROOF_PREFIXES
from skein.plans.queries import CONTEXT, EXCLUDED, TEXT_SHARD, TOKEN_SHARD

WORDISH = r"[\p{L}\p{N}_]"
OTHER = r"[^\p{L}\p{N}_]"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def values(items: list[str], name: str) -> str:
    return "(VALUES " + ", ".join("('" + v.replace("'", "''") + "')" for v in items) + f") AS {name}({name})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def normalize(x: str) -> str:
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    return strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def count(alternatives: str, text: str = "wide") -> str:
    """Whole words in ``wide``, in which every sign stands twice, so that one sign ends a word and begins the next."""
    a = alternatives.replace("[_ ]?", "(?:_|  )?").replace("[_ ]", "(?:_|  )") if "[_ ]" in alternatives else alternatives.replace(" ", "  ")
    return rf"len(regexp_extract_all({text}, '{OTHER}(?:{a}){OTHER}'))"


def follow(sign: str) -> str:
    """A word with a sign behind it and a word behind that."""
    doubled = {"class ": "class  ", r"open\(": r"open\(\(", r"os\.": r"os\.\.", r"sys\.": r"sys\.\."}[sign]
    return rf"len(regexp_extract_all(wide, '{OTHER}{doubled}{WORDISH}'))"


TEXTS = "(SELECT doc_id, source, source_type, text FROM documents WHERE text IS NOT NULL)"
WIDE = rf"(SELECT *, ' ' || regexp_replace(lower(text), '({OTHER})', '\1\1', 'g') || ' ' AS wide FROM {TEXTS})"
LATEST = "(SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY retrieved_at DESC NULLS LAST) AS k FROM doc_catalog) WHERE k = 1)"


def estimate(x: str) -> str:
    return f"(CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END)::BIGINT"


def key(x: str) -> str:
    form = rf"regexp_replace(regexp_replace(lower({x}), '{BLANK}+', ' ', 'g'), '[^a-z0-9 =+\-*/^().,;:]+', '', 'g')"
    return f"substring(sha256({form}), 1, 24)"


def digest(x: str, where: str = "TRUE") -> str:
    return f"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, {x} AS t FROM {TEXTS} WHERE {where})"


STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:p|div|section|article|h[1-6]|li|tr)>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"


def family(s: str) -> str:
    return (
        f"CASE WHEN starts_with({s}, 'formal_') THEN 'formal_proof' WHEN starts_with({s}, 'contest_') THEN 'worked_problem' WHEN starts_with({s}, 'textbook_') THEN 'textbook_notes' "
        f"WHEN starts_with({s}, 'arxiv_') OR starts_with({s}, 'math_arxiv') THEN 'research' WHEN starts_with({s}, 'open_notes') OR starts_with({s}, 'math_wikipedia') THEN 'textbook_notes' WHEN starts_with({s}, 'synthetic_') THEN 'synthetic' ELSE 'other' END"
    )


def science(s: str, textbooks: bool) -> str:
    more = f"WHEN contains({s}, 'openstax') THEN 'textbook' " if textbooks else ""
    return (
        f"CASE WHEN contains({s}, 'arxiv') AND NOT contains({s}, 'metadata') THEN 'research_paper' WHEN contains({s}, 'metadata') THEN 'abstract_metadata' "
        f"WHEN contains({s}, 'wikipedia') OR contains({s}, 'wikibooks') THEN 'expository' {more}WHEN contains({s}, 'gutenberg') THEN 'book' ELSE 'other' END"
    )


FORMAT = (
    "CASE WHEN starts_with(source, 'formal_') THEN 'formal_code' WHEN starts_with(source, 'contest_') THEN 'problem_solution' WHEN starts_with(source, 'textbook_') THEN 'textbook_source' WHEN source = 'arxiv_math_papers' THEN 'paper' "
    "WHEN contains(source, 'metadata') THEN 'abstract_metadata' WHEN starts_with(source, 'open_notes') OR starts_with(source, 'math_wikipedia') THEN 'expository' ELSE source_type END"
)
LEVEL = (
    "CASE WHEN starts_with(source, 'formal_') THEN 'formal_proof' WHEN source = 'contest_gsm8k' THEN 'elementary' WHEN source = 'contest_hendrycks_math' THEN 'high_school_olympiad' WHEN starts_with(source, 'open_notes') THEN 'high_school_undergraduate' "
    "WHEN starts_with(source, 'textbook_') THEN 'undergraduate_graduate' WHEN source = 'arxiv_math_papers' THEN 'research' WHEN contains(lower(text), 'graduate') THEN 'graduate' ELSE 'mixed' END"
)
CONFIDENCE = "CASE WHEN regexp_matches(lower({0}), 'apache|mit|bsd|public domain|cc-by|lgpl') THEN 0.95e0 WHEN contains(lower({0}), 'see-repository-license') THEN 0.8e0 WHEN regexp_matches(lower({0}), 'verify|varies') THEN 0.45e0 ELSE 0.6e0 END"


def topics(domain: str) -> str:
    words, other = C.TOPICS[domain]
    cells = []
    for name, alternatives in words.items():
        extra = C.CODE_FOLLOW.get(name, "") if domain == "code" else ""
        parts = [count(alternatives), *[follow(s) for s in extra.split("|") if s]]
        cells.append(f"({' + '.join(parts)})::BIGINT AS {name}")
    best = f"greatest({', '.join(words)})"
    chosen = " ".join(f"WHEN {n} = {best} THEN '{n}'" for n in words)
    return f"SELECT *, CASE WHEN {best} = 0 THEN '{other}' {chosen} END AS topic FROM (SELECT doc_id, {', '.join(cells)} FROM {WIDE})"


CHARS = "greatest(1, length(text))::DOUBLE"
LINES = f"list_filter(list_transform(string_split_regex(text, '{Q.LINE_END}'), lambda x: {strip('x')}), lambda x: x <> '')"
MATH = f"least(1e0, {count(Q.MATH_WORDS)} / ({CHARS} / 1500e0))"
SYMBOL = f"least(1e0, len(regexp_extract_all(text, '{Q.SYMBOLS}')) / ({CHARS} / 25e0))"
EXTRACTION = (
    f"least(1e0, 0.65e0 + CASE WHEN coalesce(list_max(list_transform({LINES}, lambda x: length(x))), 0) < 20000 THEN 0.2e0 ELSE 0e0 END + CASE WHEN contains(text, chr(65533)) THEN 0e0 ELSE 0.1e0 END + CASE WHEN length(text) > 1000 THEN 0.05e0 ELSE 0e0 END)"
)
REPEATED = f"""(SELECT d.doc_id, coalesce(sum(CASE WHEN c > 5 THEN c ELSE 0 END), 0)::DOUBLE / greatest(1, coalesce(sum(c), 0))::DOUBLE AS repeated
    FROM {TEXTS} d LEFT JOIN (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest({LINES}) AS line FROM {TEXTS}) GROUP BY ALL) l USING (doc_id) GROUP BY d.doc_id)"""
V1 = rf"""SELECT doc_id, source, text, CASE WHEN length(text) = 0 THEN 0e0 ELSE greatest(0e0, least(1e0,
    0.65e0 + least(0.35e0, {count(Q.V1_WORDS)} / greatest(1e0, length(text)::DOUBLE / 2000e0) * 0.04e0)
    + least(0.2e0, len(regexp_extract_all(text, '{Q.SYMBOLS_V1}')) / greatest(1e0, length(text)::DOUBLE / 3000e0) * 0.03e0)
    - least(0.25e0, len(regexp_extract_all(text, ' {{8,}}')) / (len(regexp_extract_all(text, '\n')) + 1)::DOUBLE * 0.02e0)
    - CASE WHEN length(text) < 1000 THEN 0.35e0 ELSE 0e0 END - CASE WHEN list_max(list_transform(string_split_regex(text, '{Q.LINE_END}'), lambda x: length(x))) > 20000 THEN 0.15e0 ELSE 0e0 END
    - CASE WHEN source IN ({quoted(C.LOWER_WEIGHT)}) THEN 0.1e0 ELSE 0e0 END)) END AS score FROM {WIDE}"""
FEATURED = f"""(SELECT *, greatest(0e0, least(1e0, CASE family WHEN 'formal_proof' THEN 0.82e0 WHEN 'worked_problem' THEN 0.78e0 WHEN 'textbook_notes' THEN 0.8e0 WHEN 'research' THEN 0.68e0 WHEN 'synthetic' THEN 0.75e0 ELSE 0.6e0 END
    + 0.12e0 * m + 0.08e0 * s + 0.1e0 * e + 0.08e0 * confidence - 0.2e0 * repeated - CASE WHEN length(text) < 700 THEN 0.25e0 ELSE 0e0 END - CASE WHEN source = 'math_arxiv_metadata_core' THEN 0.1e0 ELSE 0e0 END)) AS quality
    FROM (SELECT w.doc_id, w.source, w.text, {family('w.source')} AS family, {MATH} AS m, {SYMBOL} AS s, {EXTRACTION} AS e, {CONFIDENCE.format("coalesce(license, '')")} AS confidence, {key('text')} AS dkey, {estimate('text')} AS n_tokens
          FROM {WIDE} w LEFT JOIN source_manifest ON name = w.source) JOIN {REPEATED} USING (doc_id))"""
BUCKET = "CASE family WHEN 'formal_proof' THEN 'formal_proofs' WHEN 'worked_problem' THEN 'worked_problems' WHEN 'research' THEN 'research' WHEN 'textbook_notes' THEN 'textbook_notes' WHEN 'synthetic' THEN 'synthetic_symbolic' ELSE 'unassigned' END"
NAMED = "(SELECT source, arg_min(bucket, ord) AS named FROM (SELECT ord, bucket, unnest(sources) AS source FROM mixture_spec) GROUP BY source)"


def bucketed(rows: str) -> str:
    return f"(SELECT b.*, coalesce(s.min_quality, 0.5e0) AS min_quality FROM (SELECT f.*, coalesce(named, {BUCKET}) AS bucket FROM {rows} f LEFT JOIN {NAMED} USING (source)) b LEFT JOIN mixture_spec s USING (bucket))"


JUDGED = f"""(SELECT *, CASE WHEN source IN ({quoted(EXCLUDED)}) THEN 'excluded_source' WHEN place > 1 THEN 'near_duplicate' WHEN bucket = 'unassigned' THEN 'unassigned_bucket' WHEN quality < min_quality THEN 'below_quality_threshold' ELSE 'ok' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY dkey ORDER BY source, doc_id) AS place FROM {bucketed(FEATURED)}))"""
SELECTED = f"""(SELECT * FROM (SELECT p.*, floor(total * target_fraction)::BIGINT AS bucket_target,
        coalesce(sum(n_tokens) OVER (PARTITION BY bucket ORDER BY quality DESC, sha256('7:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tokens_before
    FROM (SELECT *, sum(n_tokens) OVER () // 2 AS total FROM {JUDGED} WHERE reason = 'ok') p JOIN mixture_spec USING (bucket)) WHERE tokens_before < bucket_target)"""


def gate(short: int, extra: str = "", rows: str = "documents") -> str:
    low = f"WHEN {extra} THEN 'low_structure'" if extra else ""
    return f"""SELECT doc_id, source, CASE WHEN text IS NULL THEN 'unreadable' WHEN length(text) < {short} THEN 'too_short' WHEN place > 1 THEN 'duplicate' {low} ELSE 'kept' END AS reason
        FROM (SELECT *, row_number() OVER (PARTITION BY length(text) >= {short}, {key('text')} ORDER BY source, doc_id) AS place FROM {rows})"""


STRUCTURE = rf"least(1e0, len(regexp_extract_all(text, '(?m)^[ \t]*(?:def |class |return |for |while |if |import |with |try:)')) / ({CHARS} / 400e0))"
CODE_EXTRACTION = f"least(1e0, 0.7e0 + CASE WHEN len(list_filter({LINES}, lambda x: starts_with(x, '#'))) / greatest(1, len({LINES}))::DOUBLE < 0.7e0 THEN 0.2e0 ELSE 0e0 END + CASE WHEN length(text) > 200 THEN 0.1e0 ELSE 0e0 END)"

PAGES = f"(SELECT source_url AS url, text AS html FROM documents d JOIN {LATEST} c ON d.catalog_id = c.doc_id WHERE d.source_type = 'html' AND text IS NOT NULL)"
LINKS = rf"""(SELECT url, pos, regexp_replace(CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || href
        WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/(?:.*/)?)[^/]*$', '\1') || href END, '#.*$', '') AS link
    FROM (SELECT url, (i - 1)::INTEGER AS pos, replace(hrefs[i], '&amp;', '&') AS href FROM (SELECT url, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT url, regexp_extract_all(html, '(?is)<a\s+[^>]*href=["'']([^"'']+)["'']', 1) AS hrefs FROM {PAGES})))
    WHERE href <> '' AND NOT regexp_matches(href, '^(?:mailto:|javascript:|#)'))"""
HOSTS = "(SELECT DISTINCT regexp_extract(urls[1], '^https?://([^/]*)', 1) AS host FROM source_manifest UNION SELECT 'notes.example')"

ORDERS = "(SELECT DISTINCT o_orderkey % 100000 AS a, o_custkey % 997 AS b FROM orders)"
PLACE = "[" + quoted(PLACES) + "]"

def digit(x: str) -> str:
    return f"(({x} // (10 ** i)::BIGINT) % 10)"


PROBLEMS = """(SELECT unnest([printf('A %d kg object accelerates at %d m/s^2. Find the net force.', p, q), printf('A %d kg object is lifted to a height of %d m. Find its potential energy. Use g = 10 m/s^2.', p, q),
        printf('A car travels at %d m/s and accelerates at %d m/s^2 for 7 s. Find its final velocity.', p, q), printf('An engine does %d J of work in %d s. Find its power output.', p * q, q), printf('What is %d of %d?', p, q)]) AS problem,
        unnest(['newton', 'potential', 'kinematics', 'power', NULL]) AS family, unnest([1, 2, 2, 1, NULL]::BIGINT[]) AS n_steps, unnest([p * q, p * q * 10, p + q * 7, p, NULL]) AS answer
    FROM (SELECT o_orderkey % 97 + 2 AS p, o_custkey % 89 + 2 AS q FROM orders))"""


def clean_answer(x: str) -> str:
    x = rf"regexp_replace({x}, '^\s*(?i:(?:answer\s*(?:is|:)[\s*]*)+)', '')"
    x = rf"regexp_replace({x}, '\\frac\{{(-?\d+)\}}\{{(-?\d+)\}}', '\1/\2', 'g')"
    x = rf"regexp_replace({x}, '[\\()\[\]$]', '', 'g')"
    return rf"regexp_replace({strip(rf'''regexp_replace({strip(x)}, '^\*+|\*+$', '', 'g')''')}, '\.+$', '')"


CHAT = rf"""coalesce({clean_answer(r"regexp_extract_all(completion, '(?i)answer\s*(?:is|:)\s*([^\n]+)', 1)[-1]")}, regexp_extract_all(completion, '(-?\d[\d,]*(?:/\d+)?(?:\.\d+)?)', 1)[-1], nullif({strip(f"string_split({strip('completion')}, chr(10))[-1]")}, ''))"""
NORM = r"lower(trim(regexp_replace({0}, '[\s,]+', '', 'g'), '.'))"
OBSERVED = f"CASE WHEN item_id % 3 = 0 THEN expected || '0' ELSE {CHAT} END"
VALUE = r"try_cast(regexp_replace(lower(trim(regexp_replace(string_split({0}, '=')[-1], '[\s,*$\\()]+', '', 'g'), '.')), '\.$', '') AS DECIMAL(25, 6))"
SCORED = f"(SELECT item_id, family, suite, coalesce({NORM.format('expected')} = {NORM.format('o')}, FALSE) OR coalesce({VALUE.format('expected')} = {VALUE.format('o')}, FALSE) AS hit FROM (SELECT *, {OBSERVED} AS o FROM heldout_examples))"
JOBS = "(SELECT name, (i - 1)::INTEGER AS ord, urls[i] AS url, substring(sha256(urls[i]), 1, 24) AS doc_id FROM (SELECT name, urls, unnest(range(1, len(urls) + 1)) AS i FROM source_manifest))"
TODO = f"(SELECT source_url AS url, doc_id FROM doc_catalog UNION SELECT url, doc_id FROM {JOBS})"

ORACLE: dict[str, str] = {
    "catalog_totals": f"SELECT count(*) AS n_documents, coalesce(sum(byte_count), 0)::BIGINT AS n_bytes, coalesce(sum(char_count), 0)::BIGINT AS n_chars, coalesce(sum(token_estimate), 0)::BIGINT AS n_tokens FROM {LATEST} WHERE status = 'ok'",
    "catalog_by_source": f"SELECT source_name, count(*) AS n_documents, coalesce(sum(token_estimate), 0)::BIGINT AS n_tokens FROM {LATEST} WHERE status = 'ok' GROUP BY source_name",
    "catalog_errors": f"SELECT source_name, status, count(*) AS n_documents FROM {LATEST} WHERE status <> 'ok' GROUP BY ALL",
    "upsert_latest": f"SELECT doc_id, source_name, status, token_estimate, retrieved_at FROM {LATEST}",
    "job_explode": f"SELECT name, ord, url, doc_id FROM {JOBS}",
    "resume_any_status": f"SELECT doc_id, url FROM {TODO} t WHERE NOT EXISTS (SELECT 1 FROM doc_catalog c WHERE c.doc_id = t.doc_id)",
    "resume_ok_only": f"SELECT doc_id, url FROM {TODO} t WHERE NOT EXISTS (SELECT 1 FROM doc_catalog c WHERE c.doc_id = t.doc_id AND c.status = 'ok')",
    "doc_id_hash": "SELECT DISTINCT source_url, substring(sha256(source_url), 1, 24) AS hash FROM doc_catalog",
    "raw_extension": r"""SELECT DISTINCT source_url, source_type, CASE WHEN e IN ('.txt', '.html', '.htm', '.xml', '.pdf', '.json', '.md') THEN e ELSE CASE source_type WHEN 'html' THEN '.html' WHEN 'xml' THEN '.xml' WHEN 'pdf' THEN '.pdf' WHEN 'text' THEN '.txt' ELSE '.bin' END END AS extension
        FROM (SELECT *, lower(regexp_extract(regexp_replace(source_url, '[?#].*$', ''), '(\.[A-Za-z0-9]+)$', 1)) AS e FROM doc_catalog)""",
    "token_estimate": f"SELECT doc_id, {estimate('text')} AS n_tokens FROM {TEXTS}",
    "normalize_text": digest(normalize("text")),
    "normalize_local": digest(strip(rf"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '{BLANK.replace(chr(92) + 'x{9}-' + chr(92) + 'x{d}', chr(92) + 'x{9}' + chr(92) + 'x{b}-' + chr(92) + 'x{d}')}+(\n|$)', '\1', 'g')")),
    "html_strip": digest(normalize(STRIPPED), "source_type = 'html'"),
    "page_links": f"SELECT url, pos, link FROM {LINKS}",
    "allowed_links": f"SELECT link, count(*) AS n FROM {LINKS} WHERE starts_with(link, 'https://notes.example/q') AND regexp_extract(link, '^https?://([^/?#]*)', 1) = 'notes.example' GROUP BY link",
    "crawl_depth": f"""WITH pages AS (SELECT DISTINCT url FROM {PAGES} WHERE regexp_extract(url, '^https?://([^/?#]*)', 1) IN (SELECT host FROM {HOSTS})),
        first AS (SELECT DISTINCT link AS url FROM {LINKS} WHERE url IN (FROM pages) AND regexp_extract(link, '^https?://([^/?#]*)', 1) IN (SELECT host FROM {HOSTS}) AND link NOT IN (FROM pages))
        SELECT url, 0 AS depth FROM pages UNION ALL SELECT url, 1 FROM first UNION ALL SELECT 'https://notes.example/end', 2 WHERE EXISTS (FROM first)""",
    "source_families": f"SELECT source_name, {family('source_name')} AS math, {science('source_name', False)} AS physics, {science('source_name', True)} AS chemistry, CASE WHEN source_name = 'python_stdlib' THEN 'stdlib' ELSE 'repo' END AS code FROM (SELECT source_name FROM doc_catalog UNION SELECT source_name FROM {values([n for d in C.DOMAIN_SOURCES.values() for n in d], 'source_name')})",
    "format_level": f"SELECT doc_id, {FORMAT} AS format, {LEVEL} AS level FROM {TEXTS}",
    **{f"topics_{d}": topics(d) for d in C.TOPICS},
    "license_confidence": f"SELECT DISTINCT license, {CONFIDENCE.format('license')} AS confidence FROM doc_catalog",
    "buckets": f"SELECT doc_id, bucket, min_quality FROM {bucketed('(SELECT doc_id, source, ' + family('source') + ' AS family FROM documents)')}",
    "quality_v1": f"SELECT doc_id, score FROM ({V1})",
    "gate_v1": f"SELECT source, count(*) AS n_documents, sum({estimate('text')})::BIGINT AS n_tokens FROM ({V1}) WHERE source NOT IN ({quoted(C.EXCLUDED_V1)}) AND score >= 0.45e0 GROUP BY source",
    "densities": f"SELECT doc_id, {MATH} AS math_density, {SYMBOL} AS symbol_density, {EXTRACTION} AS extraction FROM {WIDE}",
    "repetition": f"SELECT doc_id, repeated FROM {REPEATED}",
    "science_densities": f"SELECT doc_id, least(1e0, {count(Q.PHYSICS_WORDS)} / ({CHARS} / 1500e0)) AS physics, least(1e0, {count(Q.CHEMISTRY_WORDS)} / ({CHARS} / 1500e0)) AS chemistry, {STRUCTURE} AS structure, {CODE_EXTRACTION} AS code_extraction FROM {WIDE}",
    "quality_v2": f"SELECT doc_id, family, quality FROM {FEATURED}",
    "dup_key": f"SELECT doc_id, {key('text')} AS dkey FROM {TEXTS}",
    "first_wins": f"SELECT doc_id, row_number() OVER (PARTITION BY {key('text')} ORDER BY source, doc_id) = 1 AS is_first FROM {TEXTS}",
    "reasons_v2": f"SELECT doc_id, bucket, reason FROM {JUDGED}",
    "reason_counts": f"SELECT bucket, reason, count(*) AS n FROM {JUDGED} GROUP BY ALL",
    "reasons_science": gate(400),
    "reasons_code": gate(200, f"{STRUCTURE} < 0.02e0"),
    "eligible_join": f"""SELECT doc_id, source_name, token_estimate, f.topic, f.format FROM {LATEST} c JOIN (SELECT doc_id, topic, format FROM
        (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY scored_at DESC NULLS LAST, topic DESC NULLS LAST, format DESC NULLS LAST) AS k FROM document_features WHERE doc_id IS NOT NULL AND eligible = 1) WHERE k = 1) f USING (doc_id) WHERE c.status = 'ok'""",
    "mixture_sample": f"SELECT doc_id, bucket, quality, n_tokens, tokens_before, bucket_target FROM {SELECTED}",
    "train_val_split": f"SELECT split, bucket, count(*) AS n_documents, sum(n_tokens)::BIGINT AS n_tokens FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) <= greatest(1, floor(count(*) OVER () * 0.02e0)) THEN 'val' ELSE 'train' END AS split FROM {SELECTED}) GROUP BY ALL",
    "curation_report": f"""SELECT CASE WHEN bucket IS NOT NULL THEN 'bucket' WHEN topic IS NOT NULL THEN 'topic' ELSE 'format' END AS dimension, coalesce(bucket, topic, format) AS value, count(*) AS n_documents, sum(n_tokens)::BIGINT AS n_tokens
        FROM (SELECT s.bucket, s.n_tokens, t.topic, f.format FROM {SELECTED} s JOIN ({topics('math')}) t USING (doc_id) JOIN (SELECT doc_id, {FORMAT} AS format FROM {TEXTS}) f USING (doc_id)) GROUP BY GROUPING SETS ((bucket), (topic), (format))""",
    "text_shards": f"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
        fold(k, shard, held, doc_id, n) AS (SELECT k, 1, n, doc_id, n FROM docs WHERE k = 1 UNION ALL
            SELECT d.k, CASE WHEN f.held >= {TEXT_SHARD} THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.held >= {TEXT_SHARD} THEN d.n ELSE f.held + d.n END, d.doc_id, d.n FROM fold f JOIN docs d ON d.k = f.k + 1)
        SELECT shard::BIGINT AS shard_idx, count(*) AS n_documents, sum(n)::BIGINT AS n_chars, min(doc_id) AS first_id FROM fold GROUP BY shard""",
    "token_shards": f"""WITH placed AS (SELECT doc_id, {estimate('text')} + 1 AS n, coalesce(sum({estimate('text')} + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM {TEXTS}),
        parts AS (SELECT *, unnest(range(place // {TOKEN_SHARD}, (place + n - 1) // {TOKEN_SHARD} + 1)) AS k FROM placed)
        SELECT doc_id, k + 1 AS shard_idx, greatest(place, k * {TOKEN_SHARD}) - place AS doc_from, greatest(place, k * {TOKEN_SHARD}) - k * {TOKEN_SHARD} AS shard_from, least(place + n, (k + 1) * {TOKEN_SHARD}) - greatest(place, k * {TOKEN_SHARD}) AS n FROM parts""",
    "token_windows": f"""SELECT doc_id, place AS at, array_to_string(ids[place + 1:place + {CONTEXT}], ',') AS x, array_to_string(ids[place + 2:place + {CONTEXT} + 1], ',') AS y FROM (SELECT *, ('0x' || substring(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % (len(ids) - {CONTEXT}) AS place
        FROM (SELECT doc_id, list_transform(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), lambda x: length(x)) AS ids FROM {TEXTS}) WHERE len(ids) > {CONTEXT} + 1)""",
    "sft_rows": r"""SELECT example_id, n AS n_labels, h AS n_hidden FROM (SELECT *, least(greatest(p - 1, 0), n) AS h FROM (SELECT example_id, length('Problem: ' || trim(prompt) || chr(10) || 'Solution:') AS p,
            greatest(least(256, length('Problem: ' || trim(prompt) || chr(10) || 'Solution: ' || trim(completion))) - 1, 0) AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY built_at DESC NULLS LAST, prompt DESC, completion DESC) AS k FROM sft_examples WHERE trim(coalesce(prompt, '')) <> '' AND trim(coalesce(completion, '')) <> '') WHERE k = 1)) WHERE n > h""",
    "holdout_filter": "SELECT family, count(*) AS n FROM sft_examples WHERE prompt IS NOT NULL AND prompt NOT IN (SELECT prompt FROM heldout_examples WHERE prompt IS NOT NULL) GROUP BY family",
    "distinct_rows": "SELECT family, count(DISTINCT prompt || chr(10) || completion) AS n FROM sft_examples WHERE prompt IS NOT NULL AND completion IS NOT NULL GROUP BY family",
    "fact_pool": f"""WITH x AS (SELECT unnest(range(2, 10)) AS x), y AS (SELECT unnest(range(2, 10)) AS y), p AS (SELECT prefix FROM {values(PREFIXES, 'prefix')})
        SELECT printf('%s %d + %d.', prefix, x, y) AS prompt, x + y AS answer FROM x, y, p UNION ALL SELECT printf('%s %d * %d.', prefix, x, y), x * y FROM x, y, p UNION ALL SELECT printf('%s %d / %d.', prefix, x * y, y), x FROM x, y, p
        UNION ALL SELECT printf('%s %d - %d.', prefix, a, y), a - y FROM (SELECT unnest(range(11, 19)) AS a), y, p WHERE a - y BETWEEN 1 AND 9""",
    "digit_drills": "SELECT replace(f, '%d', n::VARCHAR) AS prompt, array_to_string(string_split(reverse(n::VARCHAR), ''), ', ') AS answer FROM (SELECT unnest(range(10, 1000)) AS n), (VALUES ('List the digits of %d from the units place.'), ('What are the digits of %d, starting from the units?'), ('Read off the digits of %d from the units upward.')) AS v(f)",
    "percent_pool": "SELECT 'What is ' || p || '% of ' || k * 20 || '?' AS prompt, p * k * 20 // 100 AS answer FROM (SELECT unnest([5, 10, 20, 25, 50, 75])::BIGINT AS p), (SELECT unnest(range(1, 201)) AS k)",
    "sum_pools": """SELECT replace(f, '%d', n::VARCHAR) AS prompt, CASE WHEN odd THEN n * n ELSE n * (n + 1) // 2 END AS answer FROM (SELECT unnest(range(2, 100)) AS n), (VALUES ('Find the sum of the first %d odd positive integers.', TRUE), ('What is 1 + 3 + 5 + ... through the first %d odd positive integers?', TRUE),
        ('Compute the sum of the first %d odd positive integers.', TRUE), ('Find 1 + 2 + ... + %d.', FALSE), ('Find the sum of the first %d positive integers.', FALSE), ('Compute 1 + 2 + ... + %d.', FALSE)) AS v(f, odd)""",
    "parity_proofs": f"SELECT prefix || ' if ' || v || ' is ' || q || ', then ' || v || '^2 is ' || q || '.' AS prompt, v || '^2 is ' || q AS answer FROM {values(PROOF_PREFIXES, 'prefix')}, {values(['n', 'm', 'r', 't'], 'v')}, {values(['even', 'odd'], 'q')}",
    "add_trace": f"""SELECT a, b, array_to_string(list_concat(list_transform(range(n), lambda i: {PLACE}[i + 1] || ': ' || {digit('a')} || ' + ' || {digit('b')} || CASE WHEN a % (10 ** i)::BIGINT + b % (10 ** i)::BIGINT >= (10 ** i)::BIGINT THEN ' + 1 carried' ELSE '' END
            || ' = ' || ({digit('a')} + {digit('b')} + (a % (10 ** i)::BIGINT + b % (10 ** i)::BIGINT >= (10 ** i)::BIGINT)::BIGINT) || ', write ' || (({digit('a')} + {digit('b')} + (a % (10 ** i)::BIGINT + b % (10 ** i)::BIGINT >= (10 ** i)::BIGINT)::BIGINT) % 10)
            || CASE WHEN {digit('a')} + {digit('b')} + (a % (10 ** i)::BIGINT + b % (10 ** i)::BIGINT >= (10 ** i)::BIGINT)::BIGINT >= 10 THEN ', carry 1' ELSE '' END),
        CASE WHEN a + b >= (10 ** n)::BIGINT THEN ['write the final carry 1'] ELSE [] END), '; ') || '; the digits give ' || (a + b) AS trace FROM (SELECT *, greatest(length(a::VARCHAR), length(b::VARCHAR)) AS n FROM {ORDERS})""",
    "sub_trace": f"""SELECT a, b, array_to_string(list_transform(range(length(a::VARCHAR)), lambda i: {PLACE}[i + 1] || ': ' || {digit('a')} || ' - ' || ({digit('b')} + (a % (10 ** i)::BIGINT < b % (10 ** i)::BIGINT)::BIGINT)
            || CASE WHEN {digit('a')} < {digit('b')} + (a % (10 ** i)::BIGINT < b % (10 ** i)::BIGINT)::BIGINT THEN ' needs a borrow, so ' || ({digit('a')} + 10) || ' - ' || ({digit('b')} + (a % (10 ** i)::BIGINT < b % (10 ** i)::BIGINT)::BIGINT) || ' = ' || ({digit('a')} + 10 - {digit('b')} - (a % (10 ** i)::BIGINT < b % (10 ** i)::BIGINT)::BIGINT)
               ELSE ' = ' || ({digit('a')} - {digit('b')} - (a % (10 ** i)::BIGINT < b % (10 ** i)::BIGINT)::BIGINT) END), '; ') || '; the digits give ' || (a - b) AS trace FROM {ORDERS} WHERE a >= b""",
    "longdiv_trace": f"""SELECT a, b, array_to_string(list_transform(range(1, length(a::VARCHAR) + 1), lambda k: 'bring down ' || substring(a::VARCHAR, k, 1) || ' making ' || ((coalesce(try_cast(left(a::VARCHAR, k - 1) AS BIGINT), 0) % b) * 10 + substring(a::VARCHAR, k, 1)::BIGINT) || '; ' || b || ' * '
            || (((coalesce(try_cast(left(a::VARCHAR, k - 1) AS BIGINT), 0) % b) * 10 + substring(a::VARCHAR, k, 1)::BIGINT) // b) || ' = ' || (((coalesce(try_cast(left(a::VARCHAR, k - 1) AS BIGINT), 0) % b) * 10 + substring(a::VARCHAR, k, 1)::BIGINT) // b * b)
            || ', remainder ' || (left(a::VARCHAR, k)::BIGINT % b)), '; ') || '; the quotient digits give ' || (a // b) AS trace FROM {ORDERS} WHERE b > 0""",
    "mul_products": f"""SELECT a, b, array_to_string(list_filter(flatten(list_transform(range(length(a::VARCHAR)), lambda i: list_transform(range(length(b::VARCHAR)), lambda j: CASE WHEN {digit('a')} = 0 OR ((b // (10 ** j)::BIGINT) % 10) = 0 THEN NULL
        ELSE ({digit('a')} * (10 ** i)::BIGINT) || ' * ' || (((b // (10 ** j)::BIGINT) % 10) * (10 ** j)::BIGINT) || ' = ' || ({digit('a')} * ((b // (10 ** j)::BIGINT) % 10) * (10 ** (i + j))::BIGINT) END))), lambda x: x IS NOT NULL), '; ') AS products FROM {ORDERS}""",
    "gcd_pairs": f"SELECT a, b, gcd(a, b)::BIGINT AS gcd FROM {ORDERS}",
    "tile_pool": "WITH pool AS (SELECT *, row_number() OVER (ORDER BY prompt) - 1 AS k FROM (SELECT 'What is ' || p || '% of ' || k * 20 || '?' AS prompt, p * k * 20 // 100 AS answer FROM (SELECT unnest([5, 10, 20, 25, 50, 75])::BIGINT AS p), (SELECT unnest(range(1, 201)) AS k))) SELECT i, prompt, answer FROM (SELECT unnest(range(5000)) AS i) JOIN pool ON i % 1200 = k",
    "weighted_targets": "SELECT name, weight::BIGINT AS weight, 120000 * weight // sum(weight) OVER ()::BIGINT AS target FROM (VALUES ('newton', 5), ('momentum', 5), ('potential', 6), ('kinematics', 6), ('ohm_i', 8), ('density', 8), ('div', 14), ('digits', 4)) AS v(name, weight)",
    "norm_answer": f"SELECT item_id, {NORM.format('completion')} AS normal FROM heldout_examples",
    "extract_final": rf"SELECT DISTINCT example_id, {strip(r"regexp_replace(regexp_extract_all(completion, '(?i)final\s+answer\s*:\s*([^\n]+)', 1)[-1], '(?s)<.*$', '')")} AS final FROM sft_examples WHERE completion IS NOT NULL",
    "chat_answer": f"SELECT item_id, {CHAT} AS answer FROM heldout_examples",
    "extract_boxed": r"SELECT item_id, '\frac{' || expected || '}{7}' AS boxed FROM heldout_examples",
    "observed_number": r"SELECT item_id, regexp_extract_all(replace(regexp_replace(replace(completion || ' kg/m^3', ',', ''), '\^\s*\d+', '', 'g'), ' ', ''), '(-?\d+)', 1)[-1] AS stripped, regexp_extract_all(replace(replace(completion || ' kg/m^3', ',', ''), ' ', ''), '(-?\d+)', 1)[-1] AS plain FROM heldout_examples",
    "is_hit": f"SELECT item_id, hit FROM {SCORED}",
    "accuracy_by_family": f"SELECT family, sum(hit::INTEGER)::BIGINT AS n_hits, count(*) AS n FROM {SCORED} GROUP BY ROLLUP (family)",
    "running_accuracy": f"SELECT n, n_hits FROM (SELECT row_number() OVER (ORDER BY item_id) AS n, sum(hit::INTEGER) OVER (ORDER BY item_id)::BIGINT AS n_hits FROM {SCORED}) WHERE n % 25 = 0",
    "mono_vs_orch": f"SELECT family, count(*) AS n, sum(hit::INTEGER)::BIGINT AS n_mono, count(*) AS n_orch, count(*) - sum(hit::INTEGER)::BIGINT AS delta FROM {SCORED} GROUP BY ROLLUP (family)",
    "pass_at_1": f"SELECT count(*) AS n_tasks, sum(solved::INTEGER)::BIGINT AS n_solved FROM (SELECT suite, bool_and(hit) AS solved FROM (SELECT suite, hit FROM {SCORED} UNION ALL SELECT 'all', TRUE) GROUP BY suite)",
    "decompose_plan": f"SELECT DISTINCT problem, family, n_steps FROM {PROBLEMS}",
    "execute_plan": f"SELECT DISTINCT problem, answer FROM {PROBLEMS} WHERE family IS NOT NULL",
    "lr_schedule": "SELECT step, round(CASE WHEN step < 100 THEN 6e-4 * (step + 1) / 100e0 ELSE 6e-5 + 0.5e0 * (1 + cos(3.141592653589793e0 * least(1e0, (step - 100) / 1900e0))) * (6e-4 - 6e-5) END, 12) AS rate FROM (SELECT unnest(range(0, 2000, 25)) AS step)",
    "parameter_count": """SELECT name, (h * vocab_size + n_layers * (2 * h * h + 2 * h * kv + 3 * h * intermediate_size + 2 * h) + h + CASE WHEN tie_embeddings THEN 0 ELSE h * vocab_size END)::BIGINT AS n_parameters
        FROM (SELECT *, hidden_size::BIGINT AS h, n_kv_heads::BIGINT * (hidden_size // n_heads) AS kv FROM model_configs)""",
}


from skein.plans.oracle_more import MORE  # noqa: E402 - it needs the parts above

ORACLE |= MORE
