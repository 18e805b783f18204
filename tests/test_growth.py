"""What must not grow with the input: broadcasts, rows of a task, letters read again, samples."""

import __spark_entry__ as entry
import pytest

from .conftest import SMALL


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["bin_labels", "evaluation_table", "overlap_join", "lift_over", "nearest_distance", "least_distance", "center_outside_exons", "coverage_bp", "interval_semi_overlap"])
def test_growing_tables_are_not_broadcast(spark, capsys, name):
    """Spark broadcasts by compressed size; what may be broadcast has one row a tile, a class or an offset."""
    joins = [line for line in plan_of(entry.queries()[name](spark, SMALL), capsys).splitlines() if "BroadcastHashJoin" in line]
    assert all("_tile#" in line or "consequence_final#" in line for line in joins), joins


@pytest.mark.parametrize("name", ["interval_subtract", "interval_intersect", "recipe_flank_subtract", "region_sets"])
def test_tiles_are_dealt_to_a_number_of_tasks(spark, capsys, name):
    """Spark joins tasks by compressed size where it deals rows by itself; sorted positions are a few bytes a row there."""
    deals = [line for line in plan_of(entry.queries()[name](spark, SMALL), capsys).splitlines() if "Exchange hashpartitioning(" in line and ("_tile#" in line or "_lane#" in line)]
    assert deals and all("REPARTITION_BY_NUM" in line for line in deals), deals


def test_touched_and_covered_make_no_rows_by_bin(spark, capsys):
    """Each interval once stood in a bin or two of every width, six rows and more, and all were shuffled."""
    from spanloom.operators import interval_joins

    rows = [(i, f"c{i % 2}", s, s + n) for i, (s, n) in enumerate([(0, 10), (5, 0), (10, 0), (10, 5), (-7, 7), (1 << 20, 9), ((1 << 20) - 3, 3), (40, 3 << 20), (99, 1)])] + [(9, None, 1, 5), (10, "c0", None, 4), (11, "c0", 4, None), (12, "c9", 4, 8)]
    a = spark.createDataFrame(rows, "row_id long, chrom string, start long, end long")
    b = spark.createDataFrame([(c, s, e) for _, c, s, e in rows if c != "c9"] + [("c1", 5, 12), ("c1", 2 << 20, 5 << 20)], "chrom string, start long, end long").where("start is null or start > -8")
    known = [tuple(r) for r in b.collect() if None not in tuple(r)]
    want = {r[0] for r in rows if None not in r and any(c == r[1] and r[2] < e and s < r[3] for c, s, e in known)}
    for how in ("left_semi", "left_anti"):
        df = interval_joins.overlap_join(a, b, how)
        assert "Generate explode" not in plan_of(df, capsys)
        assert sorted(r["row_id"] for r in df.collect()) == [r[0] for r in rows if (r[0] in want) == (how == "left_semi")]
    sets = spark.createDataFrame([("x", "c0", -5, 3), ("x", "c0", 9, 4 << 20), ("y", "c1", 2, 5), ("y", "c1", 1 << 20, 1 << 21)], "name string, chrom string, start long, end long")
    got = {r["row_id"]: (r["x_bp"], r["y_bp"]) for r in interval_joins.covered_bases(a.where("row_id < 9"), sets, ["x", "y"]).collect()}
    over = lambda r, n: sum(max(0, min(e, r[3]) - max(s, r[2])) for m, c, s, e in map(tuple, sets.collect()) if (m, c) == (n, r[1]))
    assert got == {r[0]: (over(r, "x"), over(r, "y")) for r in rows[:9]}
    assert not any("_bin" in line for line in plan_of(entry.queries()["flagship_window_labels"](spark, SMALL), capsys).splitlines())


def test_crowded_draws_make_no_pairs(spark, capsys):
    """Draws of a round were joined with themselves, so many draws on few free bases made pairs with the square of their number."""
    from pyspark.sql import functions as F

    from spanloom.operators import regions

    rows = [(i, f"c{i % 2}", s, s + 1 + i * 7 % 5) for i, s in enumerate([i * 31 % 23 for i in range(600)] + [i * 97 for i in range(40)])] + [(640, "c0", 131_000, 400_000), (641, "c1", 131_060, 131_080), (642, "c1", 131_079, 262_200)]
    drawn = spark.createDataFrame(rows, "row_id long, chrom string, start long, end long")
    turn = {r["row_id"]: (r["h"], r["row_id"]) for r in drawn.select("row_id", F.xxhash64(F.lit(3), "row_id").alias("h")).collect()}
    want = {a[0] for a in rows if not any(b[1] == a[1] and a[2] < b[3] and b[2] < a[3] and turn[b[0]] > turn[a[0]] for b in rows)}
    got = regions.without_lower_touching(drawn, 3)
    assert "Join" not in plan_of(got, capsys)
    assert sorted(map(tuple, got.collect())) == [r for r in rows if r[0] in want]


def test_placement_of_more_than_is_free_takes_few_rounds(spark, monkeypatch):
    """Only draws that none of a higher priority touched stayed in a round, so crowded rows went from round to round until nothing was free."""
    from spanloom.operators import regions

    written, keep = [], regions.kept
    monkeypatch.setattr(regions, "kept", lambda df: written.append(df.columns) or keep(df))
    lengths = [1 + i * 7919 % 30 for i in range(800)]
    rows = [(i, f"c{i % 2}", 0, n) for i, n in enumerate(lengths)] + [(800, "c4", 5, 25), (801, "c2", 0, 20_000), (802, "c2", 9, 20_009), (803, "c3", 0, 21), (804, None, 0, 5)]
    free = [(f"c{c}", s, s + 40 + s % 7) for c in range(2) for s in range(0, 4000, 100)] + [("c4", (1 << 17) - 10, (1 << 17) + 10), ("c2", 200_000, 220_500), ("c3", 0, 20)]
    asked, open_ = spark.createDataFrame(rows, "row_id long, chrom string, start long, end long"), spark.createDataFrame(free, "chrom string, start long, end long")
    got = sorted(map(tuple, regions.place_apart(asked, open_, 5).collect()))
    assert len(written) <= 40, len(written)
    assert [(r, c) for r, c, _, _ in got] == [(r[0], r[1]) for r in rows]
    left = {c: [0] * 230_000 for c in ("c0", "c1", "c2", "c3", "c4", None)}
    for c, s, e in free:
        left[c][s:e] = [1] * (e - s)
    for (_, c, s, e), row in zip(got, rows, strict=True):
        if s is not None:
            assert e - s == row[3] - row[2] and all(left[c][s:e])  # free, and nobody else's
            left[c][s:e] = [0] * (e - s)
    widest = {c: max(map(len, "".join(map(str, at)).split("0"))) for c, at in left.items()}
    assert all(row[3] - row[2] > widest[c] for (_, c, s, _), row in zip(got, rows, strict=True) if s is None)
    assert sum(s is None for _, _, s, _ in got[800:]) == 3 and got[800][2:] == ((1 << 17) - 10, (1 << 17) + 10)
    monkeypatch.undo()
    assert got == sorted(map(tuple, regions.place_apart(asked.repartition(5), open_.repartition(3), 5).collect()))


def test_windows_of_a_text_do_not_carry_it(spark, capsys):
    """Each window once held the whole text, so work grew with the square of its length; and each strand read the table again."""
    from spanloom.plans import catalogue

    for name in ("context_completion", "variant_examples"):
        assert plan_of(entry.queries()[name](spark, SMALL), capsys).count("FileScan") == 1
    rows = spark.createDataFrame([("a", "ac\U0001f600gtN" * 4), ("b", "acg"), ("c", ""), ("d", None)], "id string, raw string")
    assert [tuple(r) for r in catalogue.letter_windows(rows, 9).orderBy("number").collect()] == [("a", 0, "ac\U0001f600gtNac\U0001f600"), ("a", 1, "gtNac\U0001f600gtN")]


def test_letters_by_native_functions(spark, capsys):
    from pyspark.sql import functions as F

    from spanloom.functions import sequence as Q

    rows = spark.createDataFrame([("aC\U0001f600\n1T",), ("",), (None,), ("g",)], "s string")
    got = rows.select(Q.char_tokens("s").alias("ids"), Q.upper_mask("s").alias("up"), Q.loss_weights("s", 0.25).alias("w"), Q.case_encode("s", F.expr("array(3D, 1D, NULL, double('NaN'), 2D)"), 2.0).alias("c"))
    assert [tuple(r) for r in got.collect()] == [
        ([2, 3, 1, 1, 1, 5], [False, True, False, False, False, True], [1.0, 0.25, 0.25, 0.25, 1.0, 0.0], "Ac\U0001f600\n1t"),
        ([], [], [0.0], ""),
        (None, None, None, None),
        ([4], [False], [0.0], "G"),
    ]
    assert "lambda" not in plan_of(rows.select(Q.upper_mask("s"), Q.char_tokens("s")), capsys)


def test_quality_is_learned_from_every_label(spark):
    """Blocks hold all labelled documents: mean, scale and threshold are those of all, the weights those of all pairs inside blocks."""
    import numpy as np

    from spanloom.llm import quality

    docs = spark.createDataFrame([(i, " ".join(["Word"[: 1 + i % 4] + "!" * (i * 7 % 5)] * (1 + i % 37))) for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i * 7919 % 10 > 3)) for i in range(900)], "doc_id long, quality int")
    x = np.array([quality.features(r["text"]) for r in docs.orderBy("doc_id").collect()])
    good = np.array([i * 7919 % 10 > 3 for i in range(900)])
    one, model = quality.fit(x, good), quality.learn(docs, labels, block_docs=2000)
    assert all(np.allclose(model[c], one[c], atol=1e-9) for c in ("mean", "scale", "weights", "threshold"))
    several = quality.learn(docs, labels, block_docs=200)
    assert np.allclose(several["mean"], x.mean(0)) and np.allclose(several["scale"], x.std(0) + 1e-9)
    assert not np.allclose(several["weights"], 0)
    scores = np.sort(((x - several["mean"]) / several["scale"]) @ several["weights"])
    k = int((~good).sum())
    assert abs(several["threshold"] - (scores[k - 1] + scores[k]) / 2) < 1e-9


def plain_holders(p, q, k):
    """Positives in order take their nearest unused negatives: rank of the negative to rank of the positive."""
    free, out = dict(q), {}
    for r, own in sorted(p):
        for n in sorted(free, key=lambda n: (sum((a - b) ** 2 for a, b in zip(free[n], own, strict=True)), n))[:k]:
            out[n] = r
            del free[n]
    return out


@pytest.mark.parametrize("crowd", [1024, 4])
@pytest.mark.parametrize("kind", ["even", "ties", "one place", "one line", "far tail", "crowded positives", "one feature", "three features"])
def test_a_slab_settles_as_the_plain_loop(monkeypatch, kind, crowd):
    import numpy as np
    import pandas as pd

    from spanloom.operators import matching

    monkeypatch.setattr(matching, "CROWD", crowd)
    monkeypatch.setattr(matching, "LATE", 3 if crowd == 4 else 64)
    rng = np.random.default_rng(len(kind) + crowd)
    d = {"one feature": 1, "three features": 3}.get(kind, 2)
    x = rng.normal(size=(500, d))
    label = np.arange(500) % 4 == 1
    if kind == "ties":
        x = np.round(x * 2) / 2
    elif kind == "one place":
        x[:] = 0.5
    elif kind == "one line":
        x[:, 1] = 3.0
    elif kind == "far tail":
        x[:, 0] = np.exp(3 * x[:, 0])
    elif kind == "crowded positives":
        x[label] = x[label] * 0.01 + 2
    rank = rng.permutation(500)
    columns = [f"_x{i}" for i in range(d)]
    rows = pd.DataFrame(x, columns=columns).assign(c="a", _t=0, _first=True, _last=True, _label=label, _rank=rank, _value=np.where(label, 2, matching.FREE))
    got = matching._settle(["c"], columns)(rows)
    pairs = lambda own: [(int(r), tuple(v)) for r, v in zip(rank[own], x[own].tolist(), strict=True)]
    assert dict(zip(got["_rank"], got["_holder"], strict=True)) == plain_holders(pairs(label), pairs(~label), 2)


def test_matching_sees_few_rows_twice_and_ends_in_few_rounds(spark, monkeypatch, tmp_path):
    """A slab's task had both neighbours whole, and what met at a border went to and fro between the same two slabs."""
    import uuid

    import numpy as np

    from spanloom.operators import matching

    settle, rounds = matching._settle, []

    def counted(*columns):
        run, folder = settle(*columns), tmp_path / f"round{len(rounds)}"
        folder.mkdir()
        rounds.append(folder)

        def settled(rows):
            (folder / uuid.uuid4().hex).write_text(str(len(rows)))
            return run(rows)

        return settled

    monkeypatch.setattr(matching, "_settle", counted)
    monkeypatch.setattr(matching, "SLAB", 400)
    rng = np.random.default_rng(3)
    rows = [(i, "c", float(x), float(y), i % 5 == 0) for i, (x, y) in enumerate(rng.random((4000, 2)).tolist())]
    df = spark.createDataFrame(rows, "id long, chrom string, x double, y double, label boolean").repartition(8)
    got = matching.match_features(df.where("label").drop("label"), df.where("not label").drop("label"), ["id"], ["x", "y"], ["chrom"], 2).collect()
    seen = [sum(int(f.read_text()) for f in folder.iterdir()) for folder in rounds]
    assert seen[0] < 2 * len(rows) and len(rounds) <= 4, seen
    scale = matching._scales_of_all(df, ["x", "y"])
    at = lambda r: tuple((v - scale[f][0]) / scale[f][1] for f, v in zip("xy", r[2:4], strict=True))
    want = plain_holders([(r[0], at(r)) for r in rows if r[4]], [(r[0], at(r)) for r in rows if not r[4]], 2)
    assert {r["id"]: int(r["match_group"]) for r in got if not r["label"]} == want


def test_scales_shuffle_only_values_near_the_quantiles(spark, monkeypatch):
    """All values of all features were dealt to cells and counted for three quantiles."""
    import numpy as np
    from pyspark.sql import functions as F

    from spanloom.operators import matching, ranks

    df = spark.range(200_000).select(F.pow(F.col("id") * 7919 % 200_003, 3).alias("a"), (F.col("id") * 31 % 37).cast("double").alias("b"), F.lit(4).alias("c"), F.when(F.col("id") % 3 > 0, -F.col("id")).alias("d"))
    want = {n: np.quantile([r[0] for r in df.select(n).collect() if r[0] is not None], [0.25, 0.5, 0.75]) for n in df.columns}
    monkeypatch.setattr(ranks, "quantiles", lambda *_: pytest.fail("ranks all values"))
    got = matching.robust_scales(df, df.columns)
    assert all(got[n] == pytest.approx((q[1], (q[2] - q[0]) or 1.0), rel=1e-12) for n, q in want.items())
    monkeypatch.undo()
    few = df.select("a", "b").coalesce(1).limit(9)
    assert matching.robust_scales(few, ["a", "b"]) == matching._scales_of_all(few, ["a", "b"])
