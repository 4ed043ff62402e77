"""String, markup, formula and JSON functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cleaning rules of spaced-out formulas, in order. Rules that need repeating use lookarounds.
LATEX_RULES = [
    (r"\s+", " "),
    (r"(?<=\d)\s+(?=\d)", ""),
    (r"(\d)\s*\.\s*(\d)", "$1.$2"),
    (r"(?<=[A-Z])\s+(?=[A-Z])", ""),
    (r"(?<=[a-z])\s+(?=[a-z])", ""),
    (r"~\s*([a-z])", "~$1"),
    (r"([=<>+\-])  +", "$1 "),
    (r"  +([=<>+\-])", " $1"),
    (r"\{\s+", "{"),
    (r"\s+\}", "}"),
    (r"\\\s+([a-zA-Z]+)", r"\\$1"),
    (r"(\\[a-zA-Z]+)\s+\{", "$1{"),
    (r"\}\s+\{", "}{"),
    (r"\^\s*\{", "^{"),
    (r"_\s*\{", "_{"),
    (r"\}\s*\^", "}^"),
    (r"\}\s*_", "}_"),
    (r"(\d)\s+([a-zA-Z])(?![a-zA-Z])", "$1$2"),
    (r"\\angle\b", "∠"),
    (r"\\triangle\b", "△"),
    (r"\\therefore\b", "∴"),
    (r"\\because\b", "∵"),
    (r"\\perp\b", "⊥"),
    (r"\\parallel\b", "∥"),
    (r"\\neq\b", "≠"),
    (r"\\leq\b", "≤"),
    (r"\\geq\b", "≥"),
    (r"([°△∠∴∵⊥∥≠≤≥])\s+", "$1"),
    (r"\s+([°△∠∴∵⊥∥≠≤≥])", "$1"),
    (r"(\d)\s*\\degree", "$1°"),
    (r"\\cfrac\s*\{", r"\\cfrac{"),
    (r"\\frac\s*\{", r"\\frac{"),
    (r"\(\s+", "("),
    (r"\s+\)", ")"),
    (r",\s*", ", "),
    (r"\s+", " "),
]


def collapse(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def spaced_images(c: Column, mark: str = "[이미지]") -> Column:
    """Collapsed text with single spaces around image placeholders."""
    return collapse(F.replace(F.coalesce(c, F.lit("")), F.lit(mark), F.lit(f" {mark} ")))


def brace_count(c: Column) -> Column:
    return F.length(F.replace(c, F.lit("}"), F.lit(""))) - F.length(F.replace(c, F.lit("{"), F.lit("")))


def balanced(c: Column) -> Column:
    """As many opening as closing braces."""
    return brace_count(c) == 0


def prefix_balanced(c: Column) -> Column:
    """No prefix closes more braces than it opened, and all are closed at last."""
    start = F.struct(F.lit(0).alias("open"), F.lit(True).alias("ok"))

    def step(s, x):
        now = s["open"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        return F.struct(now.alias("open"), (s["ok"] & (now >= 0)).alias("ok"))

    return F.aggregate(F.split(c, ""), start, step, lambda s: s["ok"] & (s["open"] == 0))


def clean_latex(c: Column) -> Column:
    """A spaced-out formula in its usual spelling."""
    c = F.trim(F.coalesce(c, F.lit("")))
    inner = F.trim(c.substr(F.lit(2), F.length(c) - 2))
    c = F.when(c.startswith("{") & c.endswith("}") & (F.length(c) > 1) & balanced(inner), inner).otherwise(c)
    for pattern, to in LATEX_RULES:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def clean_spans(c: Column) -> Column:
    """Every closed ``$...$`` span of a text cleaned."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\$", -1)
    inside = lambda i: (i % 2 == 1) & (i < F.size(parts) - 1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(inside(i), clean_latex(x)).otherwise(x)), "$")


def viewer_latex(c: Column, peel: int = 3) -> Column:
    """A formula for display: outer braces peeled while balanced, tight braces, spaced operators, Hangul as text."""
    c = F.trim(F.coalesce(c, F.lit("")))
    for _ in range(peel):
        inner = F.trim(c.substr(F.lit(2), F.length(c) - 2))
        c = F.when(c.startswith("{") & c.endswith("}") & (F.length(c) > 1) & prefix_balanced(inner), inner).otherwise(c)
    c = F.regexp_replace(F.regexp_replace(c, r"\{\s+", "{"), r"\s+\}", "}")
    c = F.regexp_replace(c, r"\s*([=<>])\s*", " $1 ")
    c = F.regexp_replace(c, r"([가-힣]+(?:\s+[가-힣]+)*)", r"\\text{$1}")
    return collapse(c)


def retrieval_text(c: Column) -> Column:
    """Text for retrieval: formulas as a placeholder, punctuation dropped, blanks collapsed."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\$[^$]*\$", " [수식] ")
    return collapse(F.regexp_replace(c, r"[^\p{L}\p{N}_\s\[\]]", " "))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def math_spans(c: Column) -> Column:
    """``$...$`` as HTML spans."""
    return F.regexp_replace(c, r"\$([^$]+)\$", '<span class="math">$1</span>')


def compare_key(c: Column) -> Column:
    """Trimmed, collapsed, lower-cased."""
    return F.lower(collapse(c))


def standards(c: Column) -> Column:
    """All ``[9수01-01] text`` standards of a text: (code, grade, subject, unit, number, content)."""
    pattern = r"\[(\d+)([^\d\[\]]+)(\d+)-(\d+)\]\s*([^\[]*)"
    g = lambda k: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(k))
    rows = F.arrays_zip(g(1).alias("grade"), g(2).alias("subject"), g(3).alias("unit"), g(4).alias("number"), g(5).alias("content"))
    return F.transform(rows, lambda s: F.struct(F.concat(s["grade"], s["subject"], s["unit"], F.lit("-"), s["number"]).alias("code"), s["grade"].cast("int").alias("grade"), s["subject"].alias("subject"), s["unit"].alias("unit"), s["number"].alias("number"), F.trim(s["content"]).alias("content")))


def recovered_json(c: Column) -> Column:
    """The first part of a model's answer that parses as JSON: all of it, a fenced block, the outermost braces or brackets; else null."""
    c = F.coalesce(c, F.lit(""))
    bare = lambda x: F.btrim(x, F.lit(" \t\r\n"))
    candidates = [bare(c), bare(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)), F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.regexp_extract(c, r"(?s)(\[.*\])", 1)]
    ok = lambda x: F.when(x.rlike(r"^[\[{]") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(*[ok(x) for x in candidates])


def json_strings(c: Column) -> Column:
    """A JSON array of strings, or one scalar as an array of itself; empty text is an empty array."""
    c = F.trim(F.coalesce(c, F.lit("")))
    return F.when(c == "", F.array().cast("array<string>")).when(c.startswith("["), F.coalesce(F.from_json(c, "array<string>"), F.array(c))).otherwise(F.array(c))


def numbers(c: Column) -> Column:
    """All decimal numbers of a text."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def evaluated(c: Column) -> Column:
    """The value of the first ``a op b`` of a text (+, -, *, /, x, ÷); null without one or on division by 0."""
    pattern = r"(\d+(?:\.\d+)?)\s*([+\-*/×÷])\s*(\d+(?:\.\d+)?)"
    part = lambda k: F.regexp_extract(F.coalesce(c, F.lit("")), pattern, k)
    a, op, b = F.nullif(part(1), F.lit("")).cast("double"), part(2), F.nullif(part(3), F.lit("")).cast("double")
    return F.when(op == "+", a + b).when(op == "-", a - b).when(op.isin("*", "×"), a * b).when(op.isin("/", "÷") & (b != 0), F.try_divide(a, b))


def close(a: Column, b: Column, relative: float = 0.01, absolute: float = 0.001) -> Column:
    """Equal within 1 % of ``b`` or 0.001."""
    return F.abs(a - b) <= F.greatest(F.abs(b) * relative, F.lit(absolute))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a percentage; 0 where b is 0."""
    return F.when(b > 0, a / F.nullif(b, F.lit(0)) * 100).otherwise(0.0)


def path_date(c: Column) -> Column:
    """The date of a ``YYYYMMDD`` or ``YYYY/MM/DD`` folder."""
    d = F.coalesce(F.nullif(F.regexp_extract(c, r"(?:^|/)(\d{8})(?:/|$)", 1), F.lit("")), F.nullif(F.regexp_replace(F.regexp_extract(c, r"(?:^|/)(\d{4}/\d{2}/\d{2})(?:/|$)", 1), "/", ""), F.lit("")))
    return F.to_date(F.try_to_timestamp(d, F.lit("yyyyMMdd")))


# Entity patterns, and how strictly the entities of a subject are verified.
ENTITIES = {
    "year": (r"(\d{4})년", 1),
    "date": (r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일", 3),
    "person": (r"([가-힣]{2,4})\s*(?:은|는|이|가|의|를|에게)", 1),
    "event": (r"([가-힣]+(?:전쟁|혁명|운동|사건|협정|조약))", 1),
    "place": (r"([가-힣]+(?:시|도|군|구|읍|면|동|리|국|나라))", 1),
}
VERIFICATION = {"history": "strict", "social": "strict", "science": "moderate", "korean": "moderate", "math": "skip"}


def entities(c: Column, kind: str) -> Column:
    """Distinct entities of a kind in a text, in the order of their first places; the groups of a pattern are joined."""
    pattern, groups = ENTITIES[kind]
    found = [F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(g + 1)) for g in range(groups)]
    joined = found[0]
    for part in found[1:]:
        joined = F.zip_with(joined, part, lambda a, b: F.concat(a, b))
    return F.array_distinct(joined)


def verification_mode(subject: Column) -> Column:
    """strict, moderate or skip; moderate where the subject isn't listed."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in VERIFICATION.items() for x in kv]), subject), F.lit("moderate"))


def first_attribute(attributes: Column, names: list[str], default: str) -> Column:
    """The first non-empty attribute of ``names`` in a map."""
    return F.coalesce(*[F.nullif(F.try_element_at(attributes, F.lit(n)), F.lit("")) for n in names], F.lit(default))
