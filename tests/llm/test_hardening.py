"""Words made to collide, columns named like the operators' own, slots that do not
depend on partitions, and inputs that once took quadratic time or unbounded memory."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from weblens.llm import decontaminate, exact_dedup, license_scan, line_dedup, ngram_join, pii, sharding, substring_dedup
from weblens.llm.textops import NOT_SPACE, words


def thue_morse(n, a="a", b="b"):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


ONE = "".join(thue_morse(1024))
OTHER = "".join(thue_morse(1024, "b", "a"))
CLASHING = "doc_id long, text string, __doc_id string, __sha int, __dig binary, __th long, row int, id int, gone string, hit int, kept boolean, `a b` int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, b"d", 2, n, 4, "g", 5, True, 6) for n, (i, t) in enumerate(rows)], CLASHING)


def hashes(*ws):
    return words(np.frombuffer(" ".join(ws).encode(), dtype=np.uint8), NOT_SPACE)[2]


def test_patterned_words_do_not_share_a_hash():
    for size in (512, 1024, 2048, 4096):
        a, b = hashes("".join(thue_morse(size)), "".join(thue_morse(size, "b", "a")))
        assert a != b
    r = random.Random(1)
    ws = list({"".join(r.choice("ab\0é") for _ in range(r.randint(1, 30))) for _ in range(20000)})
    assert len(set(hashes(*ws).tolist())) == len(ws)
    h = hashes(*ws, *reversed(ws))
    assert (h[:len(ws)] == h[len(ws):][::-1]).all()


def test_patterned_words_are_different_words(spark):
    rows = [(1, " ".join([ONE] * 40)), (2, " ".join([OTHER] * 40))]
    rows += [(3, " ".join([ONE + "x", *"qwertz" * 8])), (4, " ".join([OTHER + "x", *"qwertz" * 8]))]
    docs = spark.createDataFrame(rows[:2], "doc_id long, text string")
    items = spark.createDataFrame([("i", ONE)], "item_id string, text string")
    hit = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, items).collect()}
    assert hit == {1: 40, 2: 0}
    near = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 2}
    single = spark.createDataFrame([(1, ONE), (2, OTHER)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(single).collect()} == {1: 1, 2: 2}
    filler = " ".join(f"w{i}" for i in range(34))
    windows = spark.createDataFrame([(1, f"{ONE} {filler}"), (2, f"{OTHER} {filler}")], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.remove_repeats(windows).collect()} == {0}


def test_patterned_lines_are_different_lines(spark):
    lines = [(1, f"{ONE} two"), (2, f"{OTHER} two"), (3, " ".join(thue_morse(2048, "ab", "cd"))), (4, " ".join(thue_morse(2048, "cd", "ab"))), (5, f"{ONE} two")]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_filters_keep_clashing_columns(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "a"), (2, "a"), (2, "a"), (None, "b"), (None, "b"), (3, base), (4, base + " more"), (5, None), (6, "")]
    docs = clashing(spark, rows)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(2, "a"), (None, "b"), (3, base), (4, base + " more"), (6, "")])
    near = ngram_join.keep_one(docs.filter("doc_id > 2"))
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == [3, 5, 6]
    items = spark.createDataFrame([("i", base)], "item_id string, text string")
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(x for x in rows if base not in (x[1] or ""))
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_rounds_grow_with_the_rows(spark):
    assert [exact_dedup.rounds_for(n) for n in (0, 128_000_000, 128_000_001, 10 ** 11)] == [2, 2, 3, 6]
    rows = [(i, f"t{i % 7}") for i in range(60)]
    docs = clashing(spark, rows)
    two, three = ({(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, rounds=n).collect()} for n in (2, 3))
    assert two == three


def test_slots_follow_from_seed_and_rows(spark):
    rows = [(i, f"t{i % 50}") for i in range(3000)] + [(None, "x"), (None, "y")]
    docs = clashing(spark, rows)

    def slots(parts, shuffles, **kw):
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
        try:
            return {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in sharding.assign(docs.repartition(parts), rows_per_bucket=64, **kw).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    a = slots(3, 4)
    assert a == slots(7, 21) and a != slots(3, 4, seed=5)


def test_fisher_yates_is_a_fair_shuffle(spark):
    from pyspark.sql import functions as F

    df = spark.range(6000).select("id", F.array(*[F.lit(i) for i in range(4)]).alias("a"))
    got = Counter(tuple(r.s) for r in df.select(sharding.fisher_yates(F.col("a"), F.lit(9), F.col("id")).alias("s")).collect())
    assert len(got) == 24 and min(got.values()) > 180 and max(got.values()) < 320
    odd = spark.sql("SELECT array() AS a UNION ALL SELECT array(1)").select(sharding.fisher_yates(F.col("a"), F.lit(1)).alias("s")).collect()
    assert sorted(len(r.s) for r in odd) == [0, 1]


def test_buckets_follow_bytes(spark, tmp_path):
    docs = clashing(spark, [(i, "x" * 5000) for i in range(40)])
    sharding.write_shards(docs, str(tmp_path / "out"), n_shards=2, bucket_bytes=20_000)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter(r.rec.doc_id for r in back) == Counter(range(40))
    for s in (0, 1):
        at = sorted(r.slot for r in back if r.shard == s)
        assert at == list(range(len(at)))


def test_license_notices_beyond_the_base():
    base, more = tuple(license_scan.NOTICES.items()), tuple(license_scan.MORE_NOTICES.items())
    for phrase, label in more:
        assert license_scan.edits_allowed(phrase) >= 1
        for text, edits in ((phrase.upper(), 0), (phrase.replace("e", "", 1), 1)):
            row = license_scan.scan_text(f"see the {text} here".encode(), base, more)
            assert label in row[5].split(","), text
            assert row[6] == 1.0 if edits == 0 else 0 < row[6] <= 1
    row = license_scan.scan_text(b"Mozilla Public Licence and MIT License", base, more)
    assert row[1:5] == (1, 4, 4, "mit") and row[5] == "mit,mpl"


def test_license_dense_texts_take_linear_time():
    base, more = tuple(license_scan.NOTICES.items()), tuple(license_scan.MORE_NOTICES.items())
    t0 = time.time()
    row = license_scan.scan_text(b"mit license " * 200_000, base, more)
    assert row[1] == 200_000 and row[3] == 400_000 - 2 and time.time() - t0 < 30


@pytest.mark.parametrize("size", [40_000, 120_000])
def test_long_neighbourhoods_are_decoded_in_blocks(monkeypatch, size):
    r = np.random.default_rng(0)
    model = pii.Tagger()
    parts = ["".join(r.choice(list("0123456789 .-@ab"), n)) for n in (size, 300, 50, 1, 2000)]
    whole = model.tag(parts)
    monkeypatch.setattr(pii, "LONG", 10 ** 9)
    monkeypatch.setattr(pii, "CELLS", 10 ** 9)
    assert all((a == b).all() and len(a) == len(p) for a, b, p in zip(whole, model.tag(parts), parts))


def test_digit_tables_need_bounded_memory():
    import tracemalloc

    model = pii.Tagger()
    tracemalloc.start()
    model.tag(["0123456789 " * 30_000, *["12345"] * 2000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
