import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import hashing, text
from tidewell.operators import corpus, explain, lexicon, metrics, neardup, obfuscate
from tidewell.streaming.messages import gate_step


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("o")).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [("ngu.ng0c", "ngu.ngoc"), ("40km", "40km"), ("3.14", "3.14"), ("h3llo w0rld", "hello world"), ("", ""), ("l33t33", "l33t33")],
)
def test_lookalike(spark, given, want):
    assert one(spark, given, text.lookalike) == want


@pytest.mark.parametrize(("given", "want"), [("n.g.u", "ngu"), ("3.14", "3.14"), ("a - b", "a - b"), ("a..b", "a..b")])
def test_separators(spark, given, want):
    assert one(spark, given, text.separators) == want


@pytest.mark.parametrize(("given", "want"), [("quaaaa", "qua"), ("xoong", "xoong"), ("!!!", "!!!"), ("aaabbb", "ab")])
def test_elongation(spark, given, want):
    assert one(spark, given, text.elongation) == want


def test_plain_after_marked(spark):
    assert one(spark, "quáa", text.plain_after_marked) == "quá"
    assert one(spark, None, text.plain_after_marked) is None


def test_restore_keeps_case_and_punctuation(spark):
    run = lambda x: one(spark, x, lambda c: text.restore(c, text.lexicon_map({"ko": "không"})))
    assert run("Ko, (ko)  ok") == "Không, (không) ok"
    assert run("   ") == ""


def test_canonical_deletes_controls(spark):
    assert one(spark, " A\nb​ ", text.canonical) == "ab"
    assert one(spark, None, text.canonical) == ""


def test_unit_hash_is_stable(spark):
    df = spark.range(50).select("id", hashing.unit(F.col("id").cast("string")).alias("u"))
    assert sorted(df.collect()) == sorted(df.repartition(7).collect())
    assert all(0 <= r.u < 1 for r in df.collect())


def test_quarantine(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "A ", 1), (3, " ", 0), (4, "b", 1)], "id int, text string, label int")
    got = {r.id: r.reason for r in corpus.quarantine(corpus.with_key(rows)).collect()}
    assert got == {1: "label_conflict", 2: "label_conflict", 3: "empty_text", 4: None}


@pytest.mark.parametrize(("b", "c", "p"), [(38, 32, 0.5504), (70, 275, 7.467e-30), (3, 4, 1.0), (0, 0, 1.0), (22, 15, 0.3240)])
def test_mcnemar(spark, b, c, p):
    got = spark.range(1).select(metrics.mcnemar(F.lit(b), F.lit(c))).first()[0]
    assert math.isclose(got, p, rel_tol=2e-4)


def test_average_precision_collapses_ties(spark):
    rows = spark.createDataFrame([("s", 1, 0.5), ("s", 0, 0.5), ("s", 1, 0.9)], "g string, y int, p double")
    assert metrics.average_precision(rows, ["g"]).first()["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3, abs=1e-6)


def test_split_keeps_groups_whole(spark):
    rows = spark.createDataFrame([(i, f"g{i % 40}", "HATE" if i % 3 else "CLEAN", i % 5 != 0) for i in range(200)], "id int, g string, label string, human boolean")
    split = corpus.leakage_safe_split(rows, "g", "label", "human", 42, 0.2, 0.2)
    assert split.groupBy("g").count().where("count > 1").isEmpty()
    assert {r.split for r in rows.where("not human").join(split, "g").collect()} == {"train"}


def test_components_follow_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    got = {r.node: r.component for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 51: 50}


def plain_groups(rows):
    """{place of a row: (group, links)} by the banding's definition, over all pairs: exact copies and near texts meet."""
    import hashlib
    import re
    import unicodedata

    def canon(t):
        t = unicodedata.normalize("NFKC", t or "").casefold().strip()
        return re.sub(r"\s+", " ", "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Cc"))).strip()

    def form(c):
        c = "".join(x for x in unicodedata.normalize("NFD", c.replace("đ", "d")) if not unicodedata.combining(x))
        return " ".join("".join(x if x.isalnum() else " " for x in c).split())

    def sig(grams):
        h = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) >= len(h))

    texts = sorted({canon(t) for _, t in rows})
    forms = {c: form(c) for c in texts}
    grams = {c: {f"  {f}  "[i : i + 3] for i in range(len(f) + 2)} for c, f in forms.items() if len(f) >= 12}
    sigs = {c: sig(g) for c, g in grams.items()}
    up, links = {c: c for c in texts}, dict.fromkeys(texts, 0)

    def top(c):
        return c if up[c] == c else top(up[c])

    for a in grams:
        for b in grams:
            x, (m, n) = sigs[a] ^ sigs[b], sorted((len(forms[a]), len(forms[b])))
            if a < b and any(not x >> s & 65535 for s in (0, 16, 32, 48)) and x.bit_count() <= 8 and m / n >= 0.85 and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.9:
                links[a], links[b] = links[a] + 1, links[b] + 1
                up[top(a)] = top(b)
    least = {}
    for k, t in rows:
        g = top(canon(t))
        least[g] = min((x for x in (least.get(g), k) if x is not None), default=None)
    return sorted(((k, least[top(canon(t))], links[canon(t)]) for k, t in rows), key=str)


def prose(seed, words=60):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstuvy") for _ in range(r.randint(2, 9))) for _ in range(words))


def copies():
    """(doc_id, text): chains of edits, exact copies of linked and of unlinked texts, lone ones, ids that repeat and none."""
    rows = []
    for i in range(12):
        t = prose(i)
        rows += [(20 * i, t), (20 * i + 1, t.upper() + " ")]
        for j in range(2, 9):
            w = t.split()
            w[(7 * i + 5 * j) % len(w)] = prose(100 * i + j, 1)
            t = " ".join(w)
            rows += [(20 * i + j, t), (20 * i + j + 10, t)]
    return rows + [(900, prose(90)), (901, "short"), (902, "Short"), (903, ""), (904, None), (905, prose(91)), (905, prose(92)), (None, prose(0)), (None, prose(93))]


def test_duplicate_groups_against_all_pairs(spark, tmp_path):
    from tidewell.plans import catalogue

    rows = copies()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in catalogue.near_dup_components(spark, str(tmp_path)).select("doc_id", "component", "links").collect()), key=str)
    assert got == plain_groups(rows)
    assert len(got) == len(rows) and sum(n > 1 for _, _, n in got) > 20


def test_duplicate_groups_in_blocks(spark, monkeypatch):
    """Groups of more texts than one task takes: each two blocks meet, and every pair is judged once."""
    monkeypatch.setattr(neardup, "TEXTS", 3)
    rows = copies()
    got = sorted((tuple(r) for r in neardup.duplicate_groups(spark.createDataFrame(rows, "id long, text string"), "id").collect()), key=str)
    assert got == plain_groups(rows)


def test_a_text_is_sent_once_for_all_its_pairs(spark):
    """Ten near copies have up to 45 pairs; their texts are in no join of pairs."""
    t = prose(1).split()
    rows = [(i, " ".join([*t[:i], prose(50 + i, 1), *t[i + 1 :]])) for i in range(10)]
    forms = neardup.signed(spark.createDataFrame(rows, "k long, form string"))
    edges = neardup.form_edges(forms)
    assert "CoGroup" in edges._jdf.queryExecution().optimizedPlan().toString() and "form" not in forms.columns
    grams = [set(neardup.trigrams(f).tolist()) for _, f in rows]
    got = {tuple(r) for r in edges.collect()}
    assert got and all(len(grams[a] & grams[b]) >= 0.9 * len(grams[a] | grams[b]) for a, b in got)


@pytest.mark.parametrize("form", ["a", "abc abc abd", "đéß ab", "漢字 ab漢字", "𝒳𝒴 ab𝒳", "ab " * 3000])
def test_packed_trigrams_come_back(form):
    grams = neardup.trigrams(form)
    assert neardup.unpacked(neardup.packed(grams)).tolist() == grams.tolist() == sorted({sum(ord(c) << s for c, s in zip(f"  {form}  "[i:], (42, 21, 0))) for i in range(len(form) + 2)})
    assert len(form) < 5000 or len(neardup.packed(grams)) < 100


def test_pairs_of_a_large_group_are_counted_not_listed(spark):
    """Forty texts near one another: 780 pairs, at most 39 of which come back beside a number for each text."""
    t = prose(1, 200)
    rows = neardup.signed(spark.createDataFrame([(i, f"{t} {'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}") for i in range(40)], "k long, form string"))
    all_pairs = [tuple(r) for r in neardup.form_edges(rows).collect()]
    got = neardup.form_edges(rows, counted=True).collect()
    links = {}
    for x in (x for p in all_pairs for x in p):
        links[x] = links.get(x, 0) + 1
    assert len(all_pairs) > 200 and {r.a: r.links for r in got if r.b is None} == links
    joined = [(r.a, r.b) for r in got if r.b is not None]
    assert len(joined) < len(links) and set(joined) <= set(all_pairs)


def test_near_split_leaves_no_texts_behind(spark, tmp_path):
    from pathlib import Path

    from tidewell.functions.tables import tables_made
    from tidewell.plans import catalogue

    rows = [(i, prose(i)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    with tables_made() as made:
        got = catalogue.near_safe_split(spark, str(tmp_path))
    left = [t for t in made if Path(t.stored_at.removeprefix("file:")).exists()]
    assert left and len(left) < len(made)
    assert not {"text", "form", "variant", "__v"} & {c for t in left for c in t.columns}
    assert not any("perturbation_edits" in t.schema.simpleString() for t in made)
    assert got.count() == 40


def test_duplicate_groups_of_signs(spark):
    rows = [(1, "!!!"), (2, "! !!!!!"), (3, "?!"), (4, "??!!"), (5, "!?"), (6, ""), (7, "a!!!"), (8, "!!!")]
    got = {r.id: (r.component, r.links) for r in neardup.duplicate_groups(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (3, 0), 4: (3, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0), 8: (1, 0)}


def test_near_safe_split_keeps_near_copies_together(spark, tmp_path):
    from tidewell.plans import catalogue

    rows = [r for r in copies() if r[0] is not None and r[0] != 905]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, k % 2) for k, _ in rows if k >= 60]  # documents under 60 have no human label
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in catalogue.near_safe_split(spark, str(tmp_path)).collect()}
    assert set(got) == {k for k, _ in rows}
    homes = {}
    for k, g, _ in plain_groups(rows):
        homes.setdefault(g, set()).add((got[k].group, got[k].split))
    assert all(len(h) == 1 for h in homes.values())
    assert {r.split for k, r in got.items() if k < 60} == {"train"}
    assert len({r.split for r in got.values()}) == 3


def test_two_pass_split_merges_groups_of_variants(spark):
    """Rows 2i and 2i + 1 have other texts but the same variant."""
    rows = spark.createDataFrame([(i, prose(i), "HATE", True) for i in range(40)], "id long, text string, label string, human boolean")
    out = corpus.two_pass_split(rows, "id", "text", "label", "human", lambda r: r.select("id", F.concat(F.lit("variant "), F.expr("id div 2")).alias("variant")), 42, 0.2, 0.2).collect()
    assert len(out) == 40 and len({r.source_group for r in out}) == 40
    assert len({r.group for r in out}) == len({(r.group, r.split) for r in out}) == 20
    assert {r.group for r in out} == {str(2 * i) for i in range(20)}


def test_occlusion_against_plain_python(spark):
    words = ["the", "cat", "and", "the", "dog"]
    hit = lambda ws: sum(w in ("the", "and") for w in ws)
    for window in (1, 2, 3):
        want = [0.0] * 5
        for s in range(5):
            drop = hit(words) - hit(words[:s] + words[s + window :])
            for i in range(s, min(s + window, 5)):
                want[i] += drop
        got = spark.createDataFrame([(words,)], "w array<string>").select(explain.occlusion(F.col("w"), explain.keyword_margin(["the", "and"], 0.0), window)).first()[0]
        assert got == want


def test_span_mask(spark):
    got = spark.createDataFrame([(["ab", "cde", "f"], [3, 4])], "w array<string>, s array<int>").select(explain.span_mask(F.col("w"), F.col("s"))).first()[0]
    assert got == [0, 1, 0]


def test_lexicon_rejects_conflicts_and_chains(spark):
    e = spark.createDataFrame([("ko", "không"), ("k", "không"), ("x", "y"), ("x", "z"), ("a", "ko"), ("same", "same"), ("", "v")], "variant string, standard string")
    good, bad = lexicon.compile_lexicon(e)
    assert [(r.standard, r.variants) for r in good.collect()] == [("không", ["k", "ko"])]
    assert {(r.variant, r.reason) for r in bad.collect()} == {("x", "dictionary_conflict"), ("a", "chain"), ("same", "identity"), ("", "empty")}


def test_send_gate():
    pending, status = gate_step(None, 1, True, False)
    assert (pending, status) == ((1,), "warning")
    assert gate_step(pending, 1, True, True) == (None, "sent_anyway")
    assert gate_step(pending, 2, False, False) == (None, "sent")


def test_entry_imports_without_training_data_operators(monkeypatch):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_threshold_sweep_against_counting(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randint(0, 1), p) for p in [r.random() for _ in range(300)] + [0.01, 0.99, 0.0, 1.0, 0.5, round(0.01 + 7 * 0.98 / 199, 9)]] + [("a", 1, None)]
    got = metrics.threshold_sweep(spark.createDataFrame(rows, "s string, y int, p double"), ["s"]).collect()
    assert len(got) == 400
    for g in got:
        mine = [(y, p > g.t) for s, y, p in rows if s == g.s and p is not None]
        assert (g.tp, g.fp, g.fn, g.tn) == tuple(sum(y == a and b == c for y, b in mine) for a, c in ((1, True), (0, True), (1, False), (0, False)))


def test_mcnemar_against_binomials(spark):
    pairs = [(0, 0), (0, 5), (38, 32), (70, 275), (3, 4), (1, 0), (400, 900)]
    got = spark.createDataFrame(pairs, "b long, c long").select(metrics.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    for (b, c), g in zip(pairs, got):
        want = min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c else 1.0
        assert g.p == pytest.approx(want, rel=1e-9)


def test_nearest_rank_takes_values_that_occur(spark):
    r = random.Random(9)
    rows = [(g, r.randint(0, 9) / 10) for g in "ab" for _ in range(r.randint(5, 40))] + [("a", None), ("c", None)]
    for g in metrics.nearest_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p05": 0.05, "p50": 0.5, "p95": 0.95}).collect():
        mine = sorted(v for k, v in rows if k == g.g and v is not None)
        assert [g.p05, g.p50, g.p95] == [mine[round((len(mine) - 1) * q)] for q in (0.05, 0.5, 0.95)]


def test_likeness_is_one_measure_at_every_length():
    for n in (3, 199, 201, 900):
        a = ("wonderful people of the world " * 40)[:n]
        assert obfuscate.alike(a, a) == 1.0
        b = a[: n // 2] + "#" + a[n // 2 + 1 :]
        assert obfuscate.alike(a, b) == pytest.approx((n - 1) / n)


def test_entry_without_the_training_data_folder(tmp_path):
    """The entry imports and names its own queries where the subpackage cannot be found."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tidewell", tmp_path / "tidewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
