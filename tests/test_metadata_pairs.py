"""All pairs by metadata, from classes and their scores, equal all pairs item by item."""

from lectern.operators import groundtruth as gt


def test_classes_hold_all_pairs(spark):
    rows = [(i, [None, "", "s1", "s2"][i % 4], ["a", "b", None][i % 3], str(i % 2), "0") for i in range(30)] + [(40, None, None, "", None), (41, "alone", "", None, "9")]
    items = spark.createDataFrame(rows, "item_id long, unit_small string, unit_medium string, unit_large string, difficulty string")
    wanted = {}
    for a, *x in rows:
        for b, *y in rows:
            score = round(sum(w for u, v, w in zip(x, y, (0.4, 0.3, 0.2, 0.1), strict=True) if u and u == v), 6)
            if a < b and score:
                wanted[a, b] = score
    found = gt.metadata_pairs(items).collect()
    of = {r.a: r.b for r in found if r.kind == "member"}
    score = {(r.a, r.b): r.score for r in found if r.kind == "pair"}
    ids = sorted(of)
    got = {(a, b): s for i, a in enumerate(ids) for b in ids[i + 1 :] if (s := score.get((min(of[a], of[b]), max(of[a], of[b]))))}
    assert ids == [r[0] for r in rows] and got == wanted and len(score) < len(wanted)
