"""Item files, part files, standards and batch encoding on generated files."""

import json

from lectern.sources import encode, items

# The format of an item file.
GOOD = """<?xml version="1.0" encoding="{enc}"?><문항종류><단위문항><문항 id="{id}" qt="11 선택형"><문제><물음><단락><문자열>값은 </문자열><수식>{{ 1 0 }}</수식><문자열> 이다</문자열><그림>ID\\DrawObjPic\\a.png</그림></단락></물음>
<답항><단락><문자열>x</문자열></단락></답항><답항><단락><수식>y</수식></단락></답항></문제><정답><단락><문자열>2</문자열></단락></정답><해설><단락><문자열>풀이</문자열></단락></해설></문항></단위문항></문항종류>"""


def test_item_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.iml").write_bytes(GOOD.format(enc="utf-8", id="U1").encode("utf-8"))
    (tmp_path / "2.IML").write_bytes(GOOD.format(enc="ksc5601", id="E1").encode("euc-kr"))
    (tmp_path / "3.iml").write_bytes(b"<broken")
    (tmp_path / "4.iml").write_bytes("<문항종류><단위문항/></문항종류>".encode())
    (tmp_path / "5.txt").write_text("no item file")
    assert items.files(spark, str(tmp_path)).count() == 4
    rows = {r.source_file.rsplit("/", 1)[1]: r for r in items.parse(spark, str(tmp_path)).collect()}
    for name, id_ in (("1.iml", "U1"), ("2.IML", "E1")):
        r = rows[name]
        assert (r.id, r.answer_raw, r.parse_errors, r.images) == (id_, "2", [], ["ID/DrawObjPic/a.png"])
        assert [(b.type, b.content) for b in r.question] == [("text", "값은 "), ("latex", "{ 1 0 }"), ("text", " 이다"), ("image", "ID/DrawObjPic/a.png")]
        assert [[b.content for b in c] for c in r.choices] == [["x"], ["y"]]
    assert rows["3.iml"].parse_errors[0].startswith("malformed")
    assert rows["4.iml"].parse_errors == ["no item element"]
    assert {r.id for r in items.parse(spark, str(tmp_path), wanted='id="U').collect()} == {"U1"}


NODES = """<문항종류><단위문항><문항 id="N1" qt="31 단답형" df=" 02  상 중" cls1="A13 과정" cls4="수학" cls9="01 작은 단원" kw="가, 나" dyear="2019" qs="s" qns="n"><문제><물음><단락><문자열>값 <수식>x+1</수식> 끝</문자열><문자열>  </문자열><그림> </그림></단락></물음>
<보기><답항><단락><문자열>deep</문자열></단락></답항></보기><답항><단락><문자열>a</문자열></단락></답항></문제><정답><단락><문자열>1 </문자열><문자열>,3</문자열></단락></정답></문항></단위문항></문항종류>"""


def test_nested_and_blank_nodes(spark):
    """A formula inside a text is a block of its own, what follows it belongs to the text; blank nodes are none; options are direct children."""
    rows = [("n", NODES), ("s", NODES.replace("물음>", "다른>")), ("y", NODES.replace('dyear="2019"', 'dyear="19a"').replace('qt="31 단답형" ', ""))]
    found = {r.source_file: r for r in items.parsed(spark.createDataFrame([(p, bytearray(x.encode())) for p, x in rows], "path string, content binary")).collect()}
    n = found["n"]
    assert [(b.type, b.content) for b in n.question] == [("text", "값  끝"), ("latex", "x+1")]
    assert [[b.content for b in c] for c in n.choices] == [["a"]] and n.answer_raw == "1 ,3" and n.images == []
    assert found["s"].question == [] and found["s"].parse_errors == []
    m = n.metadata.asDict()
    assert len(m) == 17
    assert m == {
        "difficulty": " 02  상 중".split(" ", 1)[1], "difficulty_code": "02", "question_type": "단답형", "question_type_code": "31", "curriculum": "과정", "school_level": "", "grade": "", "subject": "수학", "subject_detail": "", "semester": "",
        "unit_large": "", "unit_medium": "", "unit_small": "작은 단원", "keywords": "가, 나", "year": 2019, "source": "s", "exam_name": "n",
    }
    assert found["y"].metadata.year is None and found["y"].parse_errors == ["missing qt"]


def test_schema_of_item_files(spark):
    rows = [("a", '<r><x k="1"/><x k="2"><y/></x></r>'), ("b", '<r><y k="' + "z" * 120 + '"><x/></y></r>'), ("c", "<broken"), ("d", "<r>" + "".join(f'<w n="{i:02d}"/>' for i in range(30)) + "</r>")]
    found = items.edges(spark.createDataFrame([(p, bytearray(x.encode())) for p, x in rows], "path string, content binary"))
    assert {r.tag: (r.parents, r.children) for r in items.tag_schema(found).collect()} == {"r": (["ROOT"], ["w", "x", "y"]), "x": (["r", "y"], ["y"]), "y": (["r", "x"], ["x"]), "w": (["r"], [])}
    values = {}
    for r in items.attribute_samples(found).collect():
        values.setdefault((r.tag, r.attribute), []).append(r.value)
    assert sorted(values["x", "k"]) == ["1", "2"] and values["y", "k"] == ["z" * 100 + "..."] and sorted(values["w", "n"]) == [f"{i:02d}" for i in range(10)]


def test_part_files(spark, tmp_path):
    (tmp_path / "items_part01.json").write_text(json.dumps({"items": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "items_part02.json").write_text(json.dumps([{"id": 3}]))
    found = items.parts(spark, f"{tmp_path}/items_part*.json").orderBy("file", "position").collect()
    assert [json.loads(r.item)["id"] for r in found] == [1, 2, 3]


def test_standards(spark, tmp_path):
    (tmp_path / "s.csv").write_text("code,description,domain\n 9수01-01 , x ,수\n")
    assert tuple(items.standards(spark, str(tmp_path / "s.csv")).head()) == ("9수01-01", "x", "수")


def test_encoding_resumes_and_keeps_errors(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, ""), (3, "def"), (4, "ghi")], "id long, text string")
    done = spark.createDataFrame([(4,)], "id long")
    found = {r.id: r for r in encode.vectorise(rows, done).collect()}
    assert set(found) == {1, 2, 3}
    assert found[2].error and found[2].embedding is None
    assert found[1].error is None and len(found[1].embedding) == 64


def test_trigrams_of_all_characters_at_once():
    import random
    import zlib

    from lectern.sources.encode import hashed_trigrams, trigram_crcs

    rng = random.Random(5)
    for n in range(1, 60):
        t = "".join(rng.choice("ab \x7f\x80é߿ࠀ漢￿\U00010000\U0010ffff") for _ in range(n))
        assert trigram_crcs(t).tolist() == [zlib.crc32(t[i : i + 3].encode()) for i in range(max(1, n - 2))]
    assert hashed_trigrams(["aaaa"])[0][zlib.crc32(b"aaa") % 64] == 1.0
