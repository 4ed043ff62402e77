"""Item normalisation: codes, answers, keywords, paths and assembled texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<string>"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def code_of(c: Column) -> Column:
    """The part before the first space."""
    return F.split_part(text(c), F.lit(" "), F.lit(1))


def label_of(c: Column) -> Column:
    """The part after the first space; the whole value where there is none."""
    at = F.locate(" ", text(c))
    return F.when(at > 0, text(c).substr(at + 1, F.length(c))).otherwise(text(c))


def year_of(c: Column) -> Column:
    """The year, only if all characters are digits."""
    return F.when(text(c).rlike("^[0-9]+$"), c.cast("int"))


# Attributes of item files that hold a label after a code, and the columns they fill.
LABELLED = {"df": "difficulty", "qt": "question_type", "cls1": "curriculum", "cls2": "school_level", "cls3": "grade", "cls4": "subject", "cls5": "subject_detail", "cls6": "semester", "cls7": "unit_large", "cls8": "unit_medium", "cls9": "unit_small"}
CODED = {"df": "difficulty_code", "qt": "question_type_code"}
PLAIN = {"kw": "keywords", "qs": "source", "qns": "exam_name"}


def metadata(attributes: Column) -> Column:
    """The 17 metadata columns of an item's attributes (a map), as a struct; absent ones are empty, a year that isn't all digits null."""
    of = lambda name: text(F.try_element_at(attributes, F.lit(name)))
    return F.struct(
        *[label_of(of(a)).alias(name) for a, name in LABELLED.items()],
        *[first_part(of(a)).alias(name) for a, name in CODED.items()],
        *[of(a).alias(name) for a, name in PLAIN.items()],
        year_of(of("dyear")).alias("year"),
    )


def single_answer(c: Column) -> Column:
    """1 to 5, or null."""
    return F.when(F.trim(text(c)).rlike("^[1-5]$"), F.trim(c).cast("int"))


def answer_list(c: Column) -> Column:
    """A comma list whose numeric parts all lie in 1..5 (other parts are ignored); else empty."""
    parts = F.filter(F.transform(F.split(text(c), ","), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]+$"))
    fine = (F.size(parts) > 0) & F.forall(parts, lambda x: x.rlike("^[1-5]$"))
    return F.when(text(c).contains(",") & fine, F.transform(parts, lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>"))


def answer_text(c: Column) -> Column:
    """The text of an answer that is neither a choice nor a list of choices."""
    return F.when(single_answer(c).isNull() & (F.size(answer_list(c)) == 0), F.trim(text(c))).otherwise("")


def choice_reference(c: Column) -> Column:
    """N of an answer that starts with ``N:``."""
    n = F.regexp_extract(text(c), "^([0-9]+):", 1)
    return F.when(n != "", n.cast("int"))


def alternatives(c: Column) -> Column:
    """Alternatives between bars, without the ``N:`` in front, blanks dropped."""
    return F.filter(F.transform(F.split(F.regexp_replace(text(c), "^[0-9]+:", ""), "\\|"), lambda x: F.trim(x)), lambda x: x != "")


def blanks(c: Column) -> Column:
    """Answers of successive blanks."""
    return F.filter(F.transform(F.split(text(c), "[,;|]"), lambda x: F.trim(x)), lambda x: x != "")


def is_true(c: Column) -> Column:
    # Words that mean true.
    return F.lower(F.trim(text(c))).isin("true", "참", "o", "1")


def keywords(c: Column) -> Column:
    """Tokens between commas, semicolons, underscores, hyphens and blanks; none that are all digits."""
    return F.filter(F.split(text(c), "[,;_\\-\\s]+"), lambda t: (t != "") & ~t.rlike("^[0-9]+$"))


def category(has_image: Column, n_latex: Column) -> Column:
    return F.when(has_image, "image").when(n_latex > 0, "latex").otherwise("text_only")


# Code tables of the metadata normaliser, in their order.
SUBJECTS = {"01": "국어", "02": "영어", "03": "수학", "04": "사회", "05": "과학", "06": "역사", "07": "도덕", "08": "기술가정", "09": "정보", "10": "음악", "11": "미술", "12": "체육"}
GRADES = {"01": "초1", "02": "초2", "03": "초3", "04": "초4", "05": "초5", "06": "초6", "07": "중1", "08": "중2", "09": "중3", "10": "고1", "11": "고2", "12": "고3"}
DIFFICULTIES = {"01": "easy", "02": "medium", "03": "hard", "상": "hard", "중": "medium", "하": "easy", "hard": "hard", "medium": "medium", "easy": "easy", "high": "hard", "low": "easy"}
QUESTION_TYPES = {"11": "선택형", "21": "진위형", "31": "단답형", "34": "완성형", "37": "배합형", "41": "서술형", "51": "논술형"}
SCHOOL_LEVELS = {"초": "초등학교", "중": "중학교", "고": "고등학교"}
LEVEL_CODES = {"초등학교": "01", "중학교": "02", "고등학교": "03"}


def looked_up(table: dict[str, str], c: Column) -> Column:
    """The value of ``c`` in a small table, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def first_part(c: Column) -> Column:
    """What comes before the first blanks."""
    return F.regexp_extract(c, r"^\s*(\S*)", 1)


def last_part(c: Column) -> Column:
    """What comes after the first blanks, or all of it where there are none."""
    return F.regexp_replace(F.trim(c), r"^\S+\s+", "")


def named(table: dict[str, str], c: Column) -> Column:
    """``c`` if it is one of the table's names, or null."""
    return F.when(c.isin(*table.values()), c)


def coded(c: Column, codes: dict[str, str], default: str) -> Column:
    """A code table's value: by code, by exact name, by ``CODE name``, by a name inside the value; else the default.

    Names are tried in the table's order.
    """
    v = F.trim(text(c))
    inside = F.coalesce(*[F.when((v != "") & v.contains(n), F.lit(n)) for n in dict.fromkeys(codes.values())])
    return F.coalesce(looked_up(codes, v), named(codes, v), looked_up(codes, first_part(v)), named(codes, last_part(v)), inside, F.lit(default))


def normal_subject(c: Column) -> Column:
    return coded(c, SUBJECTS, SUBJECTS["03"])


def normal_grade(c: Column) -> Column:
    """A grade such as 중2 by code, by name, by ``CODE name`` or by a number from 1 to 6; else empty."""
    v = F.trim(text(c))
    return F.coalesce(looked_up(GRADES, v), named(GRADES, v), looked_up(GRADES, first_part(v)), F.when(v.rlike("^0*[1-6]$"), F.concat(F.lit("초"), v.cast("int").cast("string"))), F.lit(""))


def normal_difficulty(c: Column) -> Column:
    """easy, medium or hard by code, Korean or English name, with or without the other in front; else medium."""
    v = F.lower(F.trim(text(c)))
    return F.coalesce(looked_up(DIFFICULTIES, v), looked_up(DIFFICULTIES, first_part(v)), looked_up(DIFFICULTIES, last_part(v)), F.lit("medium"))


def normal_question_type(c: Column) -> Column:
    """A question type by code or name; else empty."""
    v = F.trim(text(c))
    return F.coalesce(looked_up(QUESTION_TYPES, v), named(QUESTION_TYPES, v), F.lit(""))


def code_for(table: dict[str, str], name: Column) -> Column:
    """The code of a name of a code table; else empty."""
    return F.coalesce(looked_up({v: k for k, v in table.items()}, name), F.lit(""))


def school_level(grade: Column) -> Column:
    """The school level of a normalised grade; empty for an empty one."""
    return F.coalesce(looked_up(SCHOOL_LEVELS, F.substring(text(grade), 1, 1)), F.lit(""))


def normal_metadata(subject: Column, grade: Column, difficulty: Column, question_type: Column) -> Column:
    """Normalised subject, grade, school level (with their codes), difficulty and question type, as a struct."""
    s, g = normal_subject(subject), normal_grade(grade)
    level = school_level(g)
    return F.struct(
        s.alias("subject"), code_for(SUBJECTS, s).alias("subject_code"), g.alias("grade"), code_for(GRADES, g).alias("grade_code"),
        level.alias("school_level"), F.coalesce(looked_up(LEVEL_CODES, level), F.lit("")).alias("school_level_code"),
        normal_difficulty(difficulty).alias("difficulty"), normal_question_type(question_type).alias("question_type"),
    )


def grade_name(level: Column, code: Column) -> Column:
    """Grade by school level and code; middle and high schools also count from 01; without a level, 1 to 12."""
    n = F.when(text(code).rlike("^[0-9]+$"), code.cast("int"))
    # School levels with the first letter of their grades.
    name = lambda letter, k: F.concat(F.lit(letter), k.cast("string"))
    mine = lambda letter, low: F.when(n.between(low + 1, low + 3), name(letter, n - low)).when(n.between(1, 3), name(letter, n))
    by_level = F.when(level == "01", F.when(n.between(1, 6), name("초", n))).when(level == "02", mine("중", 6)).when(level == "03", mine("고", 9))
    free = F.when(n.between(1, 6), name("초", n)).when(n.between(7, 9), name("중", n - 6)).when(n.between(10, 12), name("고", n - 9))
    return F.coalesce(F.when(level.isin("01", "02", "03"), by_level).otherwise(free), F.lit(""))


def overridden(override: Column, base: Column) -> Column:
    """The override if it isn't empty, else the parsed value."""
    return F.coalesce(F.nullif(override, F.lit("")), base)


def path_of(levels: list[Column]) -> Column:
    """Non-empty levels without their number, joined by ' > '."""
    return F.array_join(F.filter(F.transform(F.array(*[text(x) for x in levels]), lambda x: F.regexp_replace(x, "^[0-9]+\\s+", "")), lambda x: x != ""), " > ")


def depth_of(levels: list[Column]) -> Column:
    """Length of the leading run of non-empty levels."""
    gap = F.array_position(F.transform(F.array(*[text(x) for x in levels]), lambda x: x == ""), True)
    return F.when(gap == 0, F.lit(len(levels)).cast("long")).otherwise(gap - 1)


def slashes(c: Column) -> Column:
    return F.translate(text(c), "\\", "/")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(slashes(c), "(\\.[^./]+)$", 1))


def folder_layout(c: Column) -> Column:
    """date: an 8-digit folder; year: a 4-digit folder; else other."""
    return F.when(slashes(c).rlike("(^|/)[0-9]{8}/"), "date").when(slashes(c).rlike("(^|/)[0-9]{4}/"), "year").otherwise("other")


def embedding_text(question: Column, choices: Column, labelled: bool = True) -> Column:
    """The text that stands for an item when it is embedded: question and numbered choices."""
    numbered = F.transform(choices, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c))
    if not labelled:
        return F.trim(F.concat_ws(" ", question, F.array_join(numbered, " ")))
    return F.when(F.size(choices) > 0, F.concat(F.lit("문제: "), question, F.lit("\n선택지:\n"), F.array_join(numbered, "\n"))).otherwise(F.concat(F.lit("문제: "), question))


def context(hits: Column, none: str = "N/A", empty: str = "no results") -> Column:
    """One text for a sorted array of (rank, item_id, score, category, text) hits."""
    one = lambda s: F.format_string("[%s] score %.3f (%s)\n%s", s["item_id"].cast("string"), s["score"], F.coalesce(s["category"], F.lit(none)), F.coalesce(s["text"], F.lit(none)))
    return F.when(F.size(hits) > 0, F.array_join(F.transform(hits, one), "\n\n")).otherwise(empty)


def render(blocks: Column, image: str = "[이미지]") -> Column:
    """An ordered array of (type, content) blocks as text: math between dollars, images as a placeholder."""
    one = lambda b: F.when(b["type"] == "latex", F.concat(F.lit("$"), b["content"], F.lit("$"))).when(b["type"] == "image", image).otherwise(b["content"])
    return F.array_join(F.transform(blocks, one), "")


def pixels(box: Column, width: Column, height: Column) -> Column:
    """A box of [ymin, xmin, ymax, xmax] in thousandths, in whole pixels."""
    at = lambda i, size: (F.get(box, F.lit(i)) / 1000 * size).cast("int")
    return F.struct(at(1, width).alias("x0"), at(0, height).alias("y0"), at(3, width).alias("x1"), at(2, height).alias("y1"))


# Answers that only point to the explanation.
POINTERS = ("해설참조", "풀이참조")


def declaration(code: Column, answer: Column, count: Column) -> Column:
    """(interaction, cardinality, base_type, correct, scored) of an item's response. Essays have no correct answer and aren't scored, nor
    are answers that only point to the explanation, whatever the kind of item."""
    bare = F.trim(answer)
    points = bare.isin(*POINTERS)
    interaction = F.when(code.isin("11", "21"), "choice").when(code.isin("31", "34"), "text_entry").otherwise("extended_text")
    keys = F.filter(F.transform(F.split(answer, ","), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]+$"))
    chosen = F.array_join(F.transform(keys, lambda x: F.concat(F.lit("choice_"), x)), ",")
    correct = F.when(points | (interaction == "extended_text"), "").when(interaction == "choice", chosen).otherwise(bare)
    return F.struct(
        interaction.alias("interaction"), F.when(count > 1, "multiple").otherwise("single").alias("cardinality"), F.when(interaction == "choice", "identifier").otherwise("string").alias("base_type"),
        correct.alias("correct"), ((interaction != "extended_text") & ~points & (bare != "")).alias("scored"),
    )
