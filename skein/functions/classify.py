"""Classification of documents: source family, format, level, topic, bucket, licence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import count_words

#: Words by topic, in the order in which ties are decided (fixed values).
MATH_TOPICS = {
    "algebra": "algebra|polynomial|ring|field|group|module|linear|matrix|vector",
    "analysis": "analysis|limit|derivative|integral|measure|functional|operator|sobolev|banach|hilbert",
    "calculus": "calculus|derivative|integral|series|taylor|differential equation",
    "geometry_topology": "geometry|topology|manifold|knot|homology|cohomology|metric|surface|curve",
    "number_theory": "number theory|prime|integer|diophantine|modular|galois|zeta",
    "probability_statistics": "probability|statistics|stochastic|random|distribution|bayesian",
    "logic_foundations": "logic|set theory|category theory|type theory|proof assistant|theorem prover",
    "combinatorics_graphs": "combinatorics|graph|enumeration|partition|matching|coloring",
    "optimization": "optimization|convex|gradient|lagrangian|linear programming|control",
}
PHYSICS_TOPICS = {
    "mechanics": "force|newton|momentum|velocity|acceleration|torque|friction|collision|kinematic|gravit",
    "energy_work": "energy|work|power|kinetic|potential|conservation|joule|watt",
    "thermodynamics": "thermodynam|heat|temperature|entropy|enthalpy|gas law|carnot|thermal",
    "waves_optics": "wave|frequency|wavelength|diffraction|interference|refraction|lens|optic|sound|resonance",
    "electromagnetism": "electric|magnetic|charge|current|voltage|circuit|capacit|induct|field|maxwell|coulomb|ohm",
    "modern_physics": "quantum|relativ|photon|electron|nucle|particle|spin|uncertainty|schr[oö]dinger|planck",
    "astro": "orbit|planet|star|galaxy|cosmo|kepler|astro",
}
CHEMISTRY_TOPICS = {
    "stoichiometry": "mole|molar|stoichiometr|molecular mass|molar mass|limiting reagent|yield|formula unit|avogadro",
    "atomic_structure": "atom|electron|proton|neutron|orbital|isotope|nucleus|quantum number|valence|shell",
    "bonding": "bond|covalent|ionic|metallic|electronegativit|lewis|vsepr|hybrid|polarity|lattice",
    "thermochemistry": "enthalpy|entropy|gibbs|thermochem|heat of|calorimet|exotherm|endotherm|spontaneous",
    "kinetics_equilibrium": "rate|kinetic|equilibrium|le chatelier|catalys|activation energy|reaction order|collision",
    "acids_bases": "acid|base|ph|pka|titrat|buffer|neutraliz|hydronium|hydroxide|conjugate",
    "electrochem_redox": "redox|oxidation|reduction|electrochem|electrode|galvanic|electrolys|cell potential|voltaic",
    "organic": "organic|hydrocarbon|alkane|alkene|alkyne|functional group|isomer|aromatic|benzene|polymer|ester|amine",
    "solutions_gases": "solution|solubilit|concentration|molarit|gas law|ideal gas|partial pressure|colligative|osmosis",
    "periodic": "periodic|element|group|period|transition metal|halogen|noble gas|alkali|metalloid",
}
CODE_TOPICS = {
    "sorting_searching": "sort|bubble|merge|quick|heap|binary[_ ]search|bisect|insertion",
    "graphs": "graph|dijkstra|bfs|dfs|adjacency|topological|spanning|node|edge",
    "strings": "str|string|substring|palindrome|anagram|regex|split|join|char",
    "math_numeric": "prime|factorial|fibonacci|gcd|modulo|matrix|sqrt|combinatoric|sieve",
    "data_structures": "stack|queue|linked[_ ]?list|tree|heap|hash|deque|trie",
    "dynamic_prog": "dynamic|memo|knapsack|subsequence|dp|recursion|recursive",
    "io_system": "read|write|argv|path|file|socket|json",
}
#: Alternatives that end in a sign, before which a word must follow (fixed values).
CODE_FOLLOW = {"data_structures": "class ", "io_system": r"open\(|os\.|sys\."}
#: Topics by domain, with the name for a text without any of the words.
TOPICS = {"math": (MATH_TOPICS, "general_math"), "physics": (PHYSICS_TOPICS, "general_physics"), "chemistry": (CHEMISTRY_TOPICS, "general_chemistry"), "code": (CODE_TOPICS, "general_python")}
#: Sources by domain (fixed values).
DOMAIN_SOURCES = {
    "physics": ["wikipedia_physics_core", "wikipedia_physics_expanded", "wikibooks_physics", "openstax_physics_textbooks", "physics_arxiv_papers", "physics_arxiv_metadata_bulk", "arxiv_physics_education", "gutenberg_physics_classics"],
    "chemistry": ["wikipedia_chemistry_core", "wikipedia_chemistry_expanded", "wikibooks_chemistry", "openstax_chemistry_textbooks", "chemistry_arxiv_papers", "chemistry_arxiv_metadata_bulk", "gutenberg_chemistry_classics"],
    "code": ["python_stdlib", "thealgorithms_python", "keon_algorithms", "geekcomputers_python"],
}
EXCLUDED_V1 = ["project_gutenberg_public_domain_seed", "wikipedia_science_seed", "arxiv_science_seed"]
LOWER_WEIGHT = ["math_arxiv_metadata_core"]


def cases(pairs: list[tuple[Column, str]], other: Column | str) -> Column:
    chain = reduce(lambda c, p: c.when(p[0], p[1]), pairs[1:], F.when(*pairs[0]))
    return chain.otherwise(other)


def math_family(s: Column) -> Column:
    a = s.startswith
    return cases([(a("formal_"), "formal_proof"), (a("contest_"), "worked_problem"), (a("textbook_"), "textbook_notes"), (a("arxiv_") | a("math_arxiv"), "research"), (a("open_notes") | a("math_wikipedia"), "textbook_notes"), (a("synthetic_"), "synthetic")], "other")


def science_family(s: Column, textbooks: bool = False) -> Column:
    """Physics; with ``textbooks`` chemistry, which knows one more family."""
    has = s.contains
    pairs = [(has("arxiv") & ~has("metadata"), "research_paper"), (has("metadata"), "abstract_metadata"), (has("wikipedia") | has("wikibooks"), "expository")]
    return cases([*pairs, *([(has("openstax"), "textbook")] if textbooks else []), (has("gutenberg"), "book")], "other")


def code_family(s: Column) -> Column:
    return F.when(s == "python_stdlib", "stdlib").otherwise("repo")


def format_of(s: Column, source_type: Column) -> Column:
    a = s.startswith
    return cases([(a("formal_"), "formal_code"), (a("contest_"), "problem_solution"), (a("textbook_"), "textbook_source"), (s == "arxiv_math_papers", "paper"), (s.contains("metadata"), "abstract_metadata"), (a("open_notes") | a("math_wikipedia"), "expository")], source_type)


def level_of(s: Column, text: Column) -> Column:
    a = s.startswith
    return cases(
        [(a("formal_"), "formal_proof"), (s == "contest_gsm8k", "elementary"), (s == "contest_hendrycks_math", "high_school_olympiad"), (a("open_notes"), "high_school_undergraduate"), (a("textbook_"), "undergraduate_graduate"), (s == "arxiv_math_papers", "research"), (F.lower(text).contains("graduate"), "graduate")],
        "mixed",
    )


def topic_counts(domain: str, text: Column, own: Column) -> dict[str, Column]:
    """Counts by topic of a text and its words (``words_of``)."""
    return {name: count_words(text, own, words, CODE_FOLLOW.get(name, "") if domain == "code" else "") for name, words in TOPICS[domain][0].items()}


def topic_of(domain: str, counts: dict[str, Column]) -> Column:
    """The topic with most words; the first of equals."""
    most = F.greatest(*counts.values())
    return cases([(most == 0, TOPICS[domain][1]), *((c == most, name) for name, c in counts.items())], TOPICS[domain][1])


def bucket_by_family(family: Column) -> Column:
    return cases([(family == "formal_proof", "formal_proofs"), (family == "worked_problem", "worked_problems"), (family == "research", "research"), (family == "textbook_notes", "textbook_notes"), (family == "synthetic", "synthetic_symbolic")], "unassigned")


def license_confidence(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike("apache|mit|bsd|public domain|cc-by|lgpl"), 0.95).when(low.contains("see-repository-license"), 0.80).when(low.rlike("verify|varies"), 0.45).otherwise(0.60)
