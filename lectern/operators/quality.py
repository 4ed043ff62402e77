"""Rule-based item quality: each function turns columns into error codes, a status or a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import strings as S

# Fixed values of the rules.
IMAGE_TYPES = [".png", ".jpg", ".jpeg", ".gif", ".bmp"]
CRITICAL = ["NO_VISUAL_EVIDENCE", "OUT_OF_SCOPE", "SAFETY_VIOLATION"]
RETRYABLE = ["AMBIGUOUS_READ", "INVALID_FORMAT", "CALCULATION_ERROR", "FACTUAL_ERROR", "BIAS_DETECTED"]
PLACEHOLDER = "[이미지]"


def codes(*rules: tuple[Column, Column | str]) -> Column:
    """Codes of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, code if isinstance(code, Column) else F.lit(code)) for c, code in rules]))


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def preprocess_errors(item_id: Column, question: Column, is_choice: Column, choices: Column, answer: Column, missing: Column) -> Column:
    return codes(
        (blank(item_id), "missing_id"),
        (blank(question), "missing_question"),
        (is_choice & (F.size(choices) == 0), "missing_choices"),
        (is_choice & ((answer < 1) | (answer > 5)), "invalid_answer_range"),
        (F.size(missing) > 0, "missing_images"),
    )


def metadata_errors(required: dict[str, Column], allowed: dict[str, tuple[Column, list[str]]], year: Column) -> Column:
    """missing_metadata_<field>, invalid_<field>:<value> and invalid_year:<value>."""
    rules = [(blank(c), f"missing_metadata_{name}") for name, c in required.items()]
    rules += [(~blank(c) & ~c.isin(*values), F.concat(F.lit(f"invalid_{name}:"), c)) for name, (c, values) in allowed.items()]
    rules.append(((year < 2000) | (year > 2030), F.concat(F.lit("invalid_year:"), year.cast("string"))))
    return codes(*rules)


def content_errors(question: Column, is_choice: Column, choices: Column, answers: Column, answer_text: Column, latex: Column) -> Column:
    n = F.size(choices)
    empty = F.filter(F.transform(choices, lambda c, i: F.when(F.trim(c) == "", i + 1)), lambda x: x.isNotNull())
    plain = codes(
        (blank(question), "empty_question"),
        (~blank(question) & (F.length(question) < 5), "question_too_short"),
        (is_choice & (n == 0), "no_choices"),
        (is_choice & (n > 0) & (n < 4), F.concat(F.lit("insufficient_choices:"), n.cast("string"))),
        (is_choice & (n > 5), F.concat(F.lit("too_many_choices:"), n.cast("string"))),
        (is_choice & (F.size(answers) == 0), "missing_answer"),
    )
    out = F.transform(F.filter(answers, lambda a: (a < 1) | (a > n)), lambda a: F.concat(F.lit("answer_out_of_range:"), a.cast("string")))
    rest = codes(
        (is_choice & (F.size(empty) > 0), F.concat(F.lit("empty_choices:["), F.array_join(empty.cast("array<string>"), ", "), F.lit("]"))),
        (~is_choice & blank(answer_text), "missing_answer_text"),
    )
    braces = F.filter(F.transform(latex, lambda x, i: F.when(~S.balanced(x), F.concat(F.lit("unbalanced_braces_in_latex:"), i.cast("string")))), lambda x: x.isNotNull())
    return F.concat(plain, F.when(is_choice, out).otherwise(F.array().cast("array<string>")), rest, braces)


def image_errors(paths: Column, known: Column, missing: Column) -> Column:
    """Errors of each path, in order, and the count of missing files. ``known``: files that exist, or null if unknown."""

    def one(p: Column) -> Column:
        ext = F.lower(F.regexp_extract(p, r"(\.[^./\\]+)$", 1))
        return F.when(blank(p), F.array(F.lit("empty_image_path"))).otherwise(
            codes(
                (p.contains("\\"), F.concat(F.lit("windows_path_format:"), p.substr(1, 30))),
                (~ext.isin(*IMAGE_TYPES), F.concat(F.lit("invalid_image_extension:"), ext)),
                (~F.array_contains(known, p), F.concat(F.lit("image_not_found:"), p.substr(1, 50))),
            )
        )

    return F.concat(F.flatten(F.transform(paths, one)), codes((F.size(missing) > 0, F.concat(F.lit("missing_images_count:"), F.size(missing).cast("string")))))


def consistency_errors(question: Column, question_images: Column, explanation: Column, explanation_images: Column) -> Column:
    marked = lambda c: F.coalesce(c, F.lit("")).contains(PLACEHOLDER)
    return codes(
        (marked(question) & (F.size(question_images) == 0), "image_placeholder_without_image"),
        ((F.size(question_images) > 0) & ~marked(question), "image_without_placeholder"),
        (marked(explanation) & (F.size(explanation_images) == 0), "explanation_image_placeholder_without_image"),
    )


def item_check(stem: Column, labels: Column, choices: Column, key: Column, explanation: Column, has_evidence: Column) -> tuple[Column, Column]:
    """(codes, status) of a generated item: too short, too few choices, blank or equal choices, a key that is no label; notes lead to REVIEW."""
    clean = F.transform(choices, lambda c: F.lower(F.trim(c)))
    found = codes(
        ((F.length(F.trim(stem)) < 10) | (F.size(choices) < 4) | F.exists(choices, lambda c: F.trim(c) == "") | ~F.array_contains(labels, key), "INVALID_FORMAT"),
        (F.size(F.array_distinct(clean)) < F.size(clean), "OPTION_OVERLAP"),
    )
    notes = (F.size(choices) > 5) | (F.length(F.trim(explanation)) < 20) | ~has_evidence
    return found, F.when(F.size(found) > 0, "FAIL").when(notes, "REVIEW").otherwise("PASS")


def document_errors(parse_errors: Column) -> Column:
    """Codes of a parsed item document's errors: malformed, no_item_element, missing_id, missing_qt, missing_question."""
    return F.transform(parse_errors, lambda e: F.replace(F.regexp_replace(e, "(?s):.*", ""), F.lit(" "), F.lit("_")))


# The safety rules, as (group, family, level, patterns); the first pattern that is found counts.
SAFETY_RULES = [
    ("bias", "gender", "high", [r"여자(?:는|가|들은)\s*(?:수학|과학|운동)을?\s*못", r"남자(?:는|가|들은)\s*(?:가사|요리|육아)를?\s*못", r"(?:남자|여자)(?:다운|답게)", r"(?:남자|여자)\s*(?:일|직업)"]),
    ("bias", "region", "high", [r"(?:경상|전라|충청|강원|제주)\s*(?:사람|도민)(?:은|들은)\s*(?:무식|게으르|거칠)", r"(?:서울|지방)\s*사람(?:은|들은)"]),
    ("bias", "age", "medium", [r"(?:노인|어르신)(?:은|들은)\s*(?:무식|고집|느림)", r"(?:젊은|어린)\s*사람(?:은|들은)\s*(?:무모|철없|버릇없)", r"꼰대", r"틀딱"]),
    ("bias", "disability", "high", [r"(?:장애인|불구자|병신|벙어리|귀머거리)", r"(?:정신|지체)\s*(?:이상|미약|결함)"]),
    ("bias", "religion", "high", [r"(?:기독교|불교|이슬람|천주교|무속)(?:는|이|가)\s*(?:미신|사이비|문제)"]),
    ("bias", "nationality", "high", [r"(?:중국인|일본인|미국인)(?:은|들은)\s*(?:더럽|무식|야만)", r"(?:조선족|다문화)\s*(?:문제|범죄)"]),
    ("inappropriate", "violence", "high", [r"(?:살인|폭행|학대|고문|강간)", r"(?:잔인하게|피투성이)"]),
    ("inappropriate", "profanity", "high", [r"(?:씨발|좆|병신|지랄|개새끼|년|놈)", r"(?:ㅅㅂ|ㅈㄹ|ㅂㅅ)"]),
    ("inappropriate", "sexual", "high", [r"(?:성관계|섹스|음란|야동)", r"(?:가슴|엉덩이|성기)"]),
    ("inappropriate", "gambling", "medium", [r"(?:도박|카지노|베팅|슬롯머신)"]),
    ("inappropriate", "drugs", "high", [r"(?:마약|대마초|필로폰|코카인|헤로인)", r"(?:흡입|투약).*(?:쾌감|기분)"]),
    ("sensitive", "political", "medium", [r"(?:보수|진보)(?:는|가)\s*(?:옳|틀|좋|나쁨)", r"(?:정당|정치인)\s*(?:비판|비난|공격)", r"(?:민주당|국민의힘|더불어민주당)"]),
    ("sensitive", "suicide", "high", [r"(?:자살|자해|극단적\s*선택)", r"(?:삶을\s*끝|죽고\s*싶)"]),
    ("sensitive", "historical_controversy", "medium", [r"(?:친일|반일|위안부|독도|일본해)", r"(?:5\.18|광주|민주화)"]),
]
#: What every hit of these rules begins with: a Korean character, or the 5 of a date.
SAFETY_STARTS = r"(?:[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7A3}]|5.18)"
MAX_RULES = 1000


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str, str, list[str]]]:
    """Rules of a JSON file of (group, family, level, rank, pattern) lines, as :func:`screen` takes them; MAX_RULES lines at most."""
    rows = spark.read.schema("`group` string, family string, level string, rank int, pattern string").json(path).orderBy("group", "family", "rank").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    families: dict[tuple, list[str]] = {}
    for r in rows:
        families.setdefault((r["group"], r.family, r.level), []).append(r.pattern)
    return [(*key, patterns) for key, patterns in families.items()]


def screen(texts: DataFrame, rules: list[tuple[str, str, str, list[str]]] | None = None, strict: bool = True) -> DataFrame:
    """(id, group, family, level, matched, code, status): a row for each family of rules that an (id, text) row breaks.

    Bias of a high level fails, of a medium one in strict mode only; inappropriate content fails; a sensitive topic of a
    high level fails and of a medium one is for review. At most 50 characters of the hit are shown. One narrow pass.
    """

    def hit(group: str, family: str, level: str, patterns: list[str]) -> Column:
        found = F.coalesce(*[F.nullif(F.regexp_extract("text", f"(?i){p}", 0), F.lit("")) for p in patterns])
        code = "BIAS_DETECTED" if group == "bias" else "SAFETY_VIOLATION"
        fails = group == "inappropriate" or level == "high" or (group == "bias" and strict)
        if group == "bias" and not fails:
            found = F.lit(None).cast("string")
        return F.when(found.isNotNull(), F.struct(F.lit(group).alias("group"), F.lit(family).alias("family"), F.lit(level).alias("level"), F.substring(found, 1, 50).alias("matched"), F.lit(code if fails else "").alias("code"), F.lit("FAIL" if fails else "REVIEW").alias("status")))

    whole = F.coalesce("text", F.lit(""))
    # every hit of the fixed rules begins with one of these, so what comes before the first of them is read once and not by each rule
    seen = texts.select("id", (F.regexp_extract(whole, f"(?s){SAFETY_STARTS}.*", 0) if rules is None else whole).alias("text")).where("text <> ''")
    return seen.select("id", F.inline(F.array_compact(F.array(*[hit(*r) for r in (SAFETY_RULES if rules is None else rules)]))))


def gender_balance(choices: Column, male: str, female: str) -> Column:
    """Whether at least three choices name a person and one gender is missing."""
    count = lambda p: F.size(F.filter(choices, lambda c: c.rlike(p)))
    return unbalanced(count(male), count(female))


def unbalanced(male: Column, female: Column) -> Column:
    """The same from counts, which may be sums over rows."""
    return (male + female >= 3) & ((male == 0) | (female == 0))


def calculation_check(stem: Column, explanation: Column, labels: Column, choices: Column, key: Column) -> tuple[Column, Column]:
    """(codes, status): numerically equal choices, a key that is no label; a result that the keyed choice doesn't show, or 0 in it, is for review."""
    numeric = F.filter(F.transform(choices, lambda c: F.sort_array(S.numbers(c))), lambda a: F.size(a) > 0)
    at = F.array_position(labels, key).cast("int")
    keyed = S.numbers(F.when(at > 0, F.get(choices, at - 1)))
    value = S.evaluated(explanation)
    found = codes((F.size(F.array_distinct(numeric)) < F.size(numeric), "OPTION_OVERLAP"), (at == 0, "CALCULATION_ERROR"))
    off = value.isNotNull() & (F.size(keyed) > 0) & ~F.exists(keyed, lambda x: S.close(value, x))
    zero = stem.rlike("[÷/]|나누") & F.exists(keyed, lambda x: x == 0)
    return found, F.when(F.size(found) > 0, "FAIL").when(off | zero, "REVIEW").otherwise("PASS")


def final_status(reports: DataFrame) -> DataFrame:
    """(item_id, final_status, codes) from (item_id, status, failure_codes) reports; an item whose only report is null retries."""
    every = reports.groupBy("item_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("failure_codes")))).alias("codes"),
        F.max(F.col("status") == "FAIL").alias("failed"),
        F.min(F.col("status") == "PASS").alias("passed"),
    )
    critical = F.arrays_overlap("codes", F.array(*[F.lit(c) for c in CRITICAL]))
    retry = (F.size("codes") > 0) & (F.size(F.array_except("codes", F.array(*[F.lit(c) for c in RETRYABLE]))) == 0)
    status = F.when(critical, "REJECT").when(F.col("failed") & retry, "RETRY").when(F.col("failed"), "REJECT").when(F.col("passed"), "PASS").otherwise("RETRY")
    return every.select("item_id", status.alias("final_status"), "codes")


def consensus(verdicts: DataFrame, require_all: bool) -> DataFrame:
    """(item_id, status, active, mean_quality) from (item_id, is_valid, quality_score, error) verdicts."""
    ok = F.col("error").isNull()
    n = verdicts.groupBy("item_id").agg(F.count(F.when(ok, 1)).alias("active"), F.count(F.when(ok & F.col("is_valid"), 1)).alias("valid"), F.count(F.when(ok & ~F.col("is_valid"), 1)).alias("invalid"), F.round(F.coalesce(F.avg(F.when(ok, F.col("quality_score"))), F.lit(0.0)), 6).alias("mean_quality"))
    if require_all:
        status = F.when(F.col("invalid") > 0, "FAIL").when(F.col("valid") == F.col("active"), "PASS").otherwise("REVIEW")
    else:
        status = F.when(F.col("valid") > F.col("invalid"), "PASS").when(F.col("invalid") > F.col("valid"), "FAIL").otherwise("REVIEW")
    return n.select("item_id", F.when(F.col("active") == 0, "REVIEW").otherwise(status).alias("status"), "active", "mean_quality")


def verdict(answer: Column) -> Column:
    """PASS, FAIL or REVIEW from a model's JSON answer with is_valid and failure_codes; REVIEW where nothing parses."""
    parsed = F.from_json(S.recovered_json(answer), "is_valid boolean, failure_codes array<string>")
    return F.when(parsed["is_valid"], "PASS").when(F.size(parsed["failure_codes"]) > 0, "FAIL").otherwise("REVIEW")


def image_consistency(score: Column) -> Column:
    return F.when(score >= 0.7, "PASS").when(score >= 0.5, "REVIEW").otherwise("FAIL")


def fact_verdict(checked: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, verified, failed, unknown, status) of all (item_id, mode) ``items`` from (item_id, outcome) rows.

    A mismatch fails, an unknown entity is for review in strict mode; an item without entities passes, and so does one that is skipped.
    """
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o)
    each = items.join(checked.groupBy("item_id").agg(n("verified"), n("failed"), n("unknown")), "item_id", "left").na.fill(0, ["verified", "failed", "unknown"])
    status = F.when(F.col("failed") > 0, "FAIL").when((F.col("mode") == "strict") & (F.col("unknown") > 0), "REVIEW").otherwise("PASS")
    return each.select("item_id", "verified", "failed", "unknown", status.alias("status"))


def entity_facts(items: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """(item_id, kind, value, outcome): the first ``most`` entities of each kind of (item_id, text, mode) rows that aren't skipped,
    looked up in a (kind, value, outcome) table; unknown where it has none."""

    def found(kind: str) -> Column:
        return F.transform(F.slice(S.entities(F.col("text"), kind), 1, most), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    kinds = [found(k) for k in S.ENTITIES]
    each = items.where(F.col("mode") != "skip").select("item_id", F.inline(F.concat(*kinds)))
    return each.join(known, ["kind", "value"], "left").select("item_id", "kind", "value", F.coalesce("outcome", F.lit("unknown")).alias("outcome"))


def image_file_errors(path: Column, size: Column, head: Column) -> Column:
    """Format, 200 to 4096 pixels a side, 20 MB at most; a missing file has null size, ``head`` is what its first bytes say (:func:`image_header`)."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    w, h = head["width"], head["height"]
    return codes((size.isNull(), "not_found"), (~ext.isin(*IMAGE_TYPES), "unsupported_format"), (size.isNotNull() & (w.isNull() | h.isNull()), "unreadable"), (F.least(w, h) < 200, "too_small"), (F.greatest(w, h) > 4096, "too_large"), (size > 20 * 1024 * 1024, "file_too_big"))
