"""SQL of the further queries, for DuckDB."""

from __future__ import annotations

from skein.operators import exercises as X
from skein.operators.curriculum import PREFIXES, PROOF_PREFIXES
from skein.plans import oracle as B
from skein.plans.queries import TOKEN_SHARD
from skein.plans.queries_more import EACH, LETTERS, ROWS, SEED, STANDING_FOR


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def drawn(seed: int, family: str, name: str, low: int, high: int) -> str:
    return f"({low} + ('0x' || substring(md5('{seed}:{family}:{name}:' || i), 1, 8))::BIGINT % {high - low + 1})"


def filled(template: str, names: set[str]) -> str:
    for n in sorted(names):
        template = f"replace({template}, {text('{' + n + '}')}, {n}::VARCHAR)"
    return template


def exercise(name: str, plain: bool = False) -> str:
    """Prompts and answers of a family, from its numbers on."""
    f = X.FAMILIES[name]
    inner = "SELECT range AS i FROM range(" + str(EACH) + ")"
    for n, (low, high) in f.draws.items():
        inner = f"SELECT *, {drawn(SEED, name, n, low, high)} AS {n} FROM ({inner})"
    for n, made in (f.let | f.texts).items():
        inner = f"SELECT *, ({made[1] if isinstance(made, tuple) else made}) AS {n} FROM ({inner})"
    names = X.used((*f.prompts, f.answer))
    prompts = "[" + ", ".join(text(p) for p in f.prompts) + "]"
    chosen = f"{prompts}[1]" if plain else f"{prompts}[{drawn(SEED, name, 'prompt', 1, len(f.prompts))}]"
    return f"SELECT '{name}' AS family, i, {filled(chosen, names)} AS prompt, {filled(text(f.answer), names)} AS answer FROM ({inner})"


def all_of(names: list[str], plain: bool = False) -> str:
    return " UNION ALL ".join(exercise(n, plain) for n in names)


def listed(values: list[str], name: str) -> str:
    return "(VALUES " + ", ".join(f"({text(v)})" for v in values) + f") AS {name}({name})"


FACTS = " UNION ALL ".join(
    f"SELECT p || ' {shown}.' AS prompt, 'Plan: {plan}. Step 1: {step}. Final answer: ' || {answer} || '.' AS completion, ({answer})::VARCHAR AS answer FROM {listed(PREFIXES, 'p')}, range(2, 10) s(x), range(2, 10) t(y)"
    for shown, plan, step, answer in (
        ("' || x || ' + ' || y || '", "know the sums of one digit by heart", "' || x || ' + ' || y || ' = ' || (x + y) || '", "(x + y)"),
        ("' || x || ' * ' || y || '", "know the products of one digit by heart", "' || x || ' * ' || y || ' = ' || (x * y) || '", "(x * y)"),
        ("' || (x * y) || ' / ' || y || '", "read the table of products backwards", "' || y || ' * ' || x || ' = ' || (x * y) || '", "x"),
        ("' || (x + y) || ' - ' || y || '", "know the differences of one digit by heart", "' || (x + y) || ' - ' || y || ' = ' || x || '", "x"),
    )
)


def facts() -> str:
    """The differences have results from 1 to 9 and first numbers from 11 to 18."""
    parts = FACTS.split(" UNION ALL ")
    parts[3] = parts[3].replace("range(2, 10) s(x)", "range(1, 10) s(x)") + " WHERE x + y BETWEEN 11 AND 18"
    return " UNION ALL ".join(parts)


def proofs() -> str:
    out = []
    pairs = ", ".join(f"('{u}', '{LETTERS[(k + 1) % len(LETTERS)]}')" for k, u in enumerate(LETTERS))
    for prompt, conclusion, lines in X.PROOFS:
        steps = " ".join(f"Step {k}: {line}." for k, line in enumerate(lines, 1))
        body = f"Plan: go back to the definitions. {steps} Final answer: {conclusion}."
        cells = [filled(text(t), {"p", "u", "v"}) for t in (prompt, body, conclusion)]
        out.append(f"SELECT {cells[0]} AS prompt, {cells[1]} AS completion, {cells[2]} AS answer FROM {listed(PROOF_PREFIXES, 'p')}, (VALUES {pairs}) q(u, v)")
    return " UNION ALL ".join(out)


def shared_out(targets: dict[str, int]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::BIGINT, 0::BIGINT)" for k, v in targets.items() if v) + ") t(label, n, n_unsolved)"


def shares(weights: dict[str, float], count: int) -> dict[str, int]:
    return {k: int(count * w / sum(weights.values())) for k, w in weights.items()}


POOLS = {f"pool:{k}": int(ROWS * v) for k, v in X.POOL_SHARES.items()}
PHYSICS = {"newton": 1, "momentum": 1, "weight": 1, "potential": 2, "kinematics": 2, "work": 1, "ohm_v": 1, "ohm_i": 1, "density": 1, "power": 1}


def domain_report(name: str) -> str:
    short, extra = (200, f"{B.STRUCTURE} < 0.02e0") if name == "code" else (400, "")
    rows = f"""(SELECT c.doc_id, c.source_name AS source, c.token_estimate, d.text FROM {B.LATEST} c LEFT JOIN (SELECT catalog_id, arg_max(text, doc_id) AS text FROM documents GROUP BY catalog_id) d ON d.catalog_id = c.doc_id
        WHERE c.status = 'ok' AND c.source_name IN ({B.quoted(STANDING_FOR[name])}))"""
    own = "(SELECT doc_id, source, NULL AS source_type, text FROM r WHERE text IS NOT NULL)"
    family = "CASE WHEN source = 'python_stdlib' THEN 'stdlib' ELSE 'repo' END" if name == "code" else B.science("source", name == "chemistry")
    return f"""WITH r AS {rows}, g AS ({B.gate(short, extra, "r")}), t AS ({B.topics(name).replace(B.TEXTS, own)}),
        j AS (SELECT r.doc_id, r.source, r.token_estimate, g.reason, t.topic, {family.replace('source', 'r.source')} AS family FROM r JOIN g USING (doc_id) LEFT JOIN t USING (doc_id))
        SELECT 'reason' AS dimension, reason AS value, count(*) AS n_documents, coalesce(sum(token_estimate), 0)::BIGINT AS n_tokens FROM j GROUP BY reason
        UNION ALL SELECT 'family', family, count(*), coalesce(sum(token_estimate), 0)::BIGINT FROM j WHERE reason = 'kept' GROUP BY family
        UNION ALL SELECT 'topic', topic, count(*), coalesce(sum(token_estimate), 0)::BIGINT FROM j WHERE reason = 'kept' GROUP BY topic"""


CELLS = f"(SELECT coalesce(family, '**overall**') AS family, suite, sum(hit::INTEGER)::BIGINT || '/' || count(*) AS cell, sum(hit::INTEGER) AS h, count(*) AS n FROM {B.SCORED} GROUP BY GROUPING SETS ((family, suite), (suite)))"
MORE: dict[str, str] = {
    "math_exercises": all_of([f.name for f in X.ARITHMETIC if f.name not in ("derivative", "integral")]),
    "physics_exercises": all_of(list(PHYSICS)),
    "chemistry_exercises": all_of([f.name for f in X.CHEMISTRY]),
    "symbolic_exercises": all_of([f.name for f in X.SYMBOLIC if f.name != "equation"]),
    "sft_seed": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {ROWS // 8}::BIGINT, {ROWS // 8}::BIGINT)" for k in X.SEED_KINDS) + f", ('proof', {4 * (ROWS // X.PROOF_EVERY)}, {ROWS // X.PROOF_EVERY})) t(family, n, n_drawn)",
    "benchmark_problems": all_of(X.BENCHMARK, plain=True),
    "fact_solutions": facts(),
    "proof_solutions": proofs(),
    "math_curriculum": shared_out(POOLS | shares(X.MATH_SHARES, ROWS - sum(POOLS.values()))),
    "physics_curriculum": shared_out(shares(X.PHYSICS_SHARES, ROWS)),
    "chemistry_curriculum": shared_out(shares(X.CHEMISTRY_SHARES, ROWS)),
    "few_shot_prompts": "SELECT item_id, 'Problem: Compute 46 + 58.' || chr(10) || 'Answer: 104' || chr(10) || chr(10) || 'Problem: What is 25% of 80?' || chr(10) || 'Answer: 20' || chr(10) || chr(10) || 'Problem: ' || prompt || chr(10) || 'Answer:' AS asked FROM heldout_examples WHERE prompt IS NOT NULL",
    "distinct_prompts": "SELECT family, count(DISTINCT prompt) AS n FROM sft_examples WHERE family IS NOT NULL AND prompt IS NOT NULL GROUP BY family",
    **{f"{d}_report": domain_report(d) for d in STANDING_FOR},
    "catalog_page": f"SELECT source_name, doc_id FROM {B.LATEST} WHERE status = 'ok' ORDER BY source_name, doc_id LIMIT 50 OFFSET 100",
    "first_ok_pages": f"SELECT doc_id, char_count FROM {B.LATEST} WHERE status = 'ok' AND char_count >= 500 ORDER BY doc_id LIMIT 100",
    "shuffled_take": f"SELECT example_id FROM (SELECT DISTINCT example_id FROM sft_examples WHERE example_id IS NOT NULL) ORDER BY sha256('{SEED}:' || example_id), example_id LIMIT 200",
    "source_frequencies": f"SELECT source_name AS value, coalesce(sum(token_estimate), 0)::BIGINT AS total FROM {B.LATEST} WHERE status = 'ok' GROUP BY source_name",
    "eval_loss": "SELECT event_type, round(avg(value), 9) AS loss, round(least(20e0, avg(value)), 9) AS log_perplexity FROM events GROUP BY event_type",
    "shard_totals": f"SELECT (sum(n) + {TOKEN_SHARD} - 1)::BIGINT // {TOKEN_SHARD} AS n_shards, sum(n)::BIGINT AS n_tokens FROM (SELECT {B.estimate('text')} + 1 AS n FROM {B.TEXTS})",
    "payload_digest": f"SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS n_bytes FROM {B.TEXTS}",
    "orchestrator_self_test": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {EACH}::BIGINT, 0::BIGINT, 0::BIGINT)" for f in PHYSICS) + ") t(family, n, n_unmatched, n_wrong)",
    "routed": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {EACH}::BIGINT, {EACH if k > 1 else 0}::BIGINT)" for f, k in PHYSICS.items()) + ") t(family, n, n_taken_apart)",
    "mono_vs_orch_problems": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {EACH}::BIGINT, {EACH if k == 1 else 0}::BIGINT, {EACH}::BIGINT, {0 if k == 1 else EACH}::BIGINT)" for f, k in PHYSICS.items())
    + f", (NULL, {EACH * len(PHYSICS)}, {EACH * sum(k == 1 for k in PHYSICS.values())}, {EACH * len(PHYSICS)}, {EACH * sum(k > 1 for k in PHYSICS.values())})) t(family, n, n_mono, n_orch, delta)",
    "manifest_rows": "SELECT doc_id, json_object('doc_id', doc_id, 'license', license, 'source', source, 'source_type', source_type)::VARCHAR AS line FROM (SELECT d.doc_id, d.source, d.source_type, m.license FROM documents d LEFT JOIN source_manifest m ON m.name = d.source)",
    "markdown_report": f"""WITH c AS {CELLS}, s AS (SELECT DISTINCT suite FROM heldout_examples), f AS (SELECT DISTINCT family FROM c),
        g AS (SELECT f.family, s.suite, CASE WHEN c.n IS NULL THEN '-' ELSE m || round_even(100e0 * h / n, 0)::INTEGER || '%' || m || ' (' || cell || ')' END AS shown
              FROM (SELECT family, CASE WHEN family = '**overall**' THEN '**' ELSE '' END AS m FROM f) f CROSS JOIN s LEFT JOIN c ON c.family = f.family AND c.suite = s.suite)
        SELECT 0 AS ord, '' AS family, '| family | ' || string_agg(suite, ' | ' ORDER BY suite) || ' |' AS line FROM s UNION ALL SELECT 1, '', '|' || repeat('---|', (count(*) + 1)::INTEGER) FROM s
        UNION ALL SELECT CASE WHEN family = '**overall**' THEN 3 ELSE 2 END, family, '| ' || family || ' | ' || string_agg(shown, ' | ' ORDER BY suite) || ' |' FROM g GROUP BY family""",
    "bench_pivot": f"SELECT family, coalesce(COLUMNS(* EXCLUDE (family)), '-') FROM (PIVOT (SELECT family, suite, cell FROM {CELLS}) ON suite USING any_value(cell) GROUP BY family)",
    "top_p_tokens": """SELECT step, token, rank FROM (SELECT *, coalesce(sum(mass) OVER (PARTITION BY step ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(mass) OVER (PARTITION BY step) AS before
        FROM (SELECT step, token, rank, exp(logit - max(logit) OVER (PARTITION BY step)) AS mass FROM (SELECT user_id % 500 AS step, event_id AS token, value AS logit, row_number() OVER (PARTITION BY user_id % 500 ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 20)) WHERE before < 0.9""",
}
