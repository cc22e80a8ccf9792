import glob
import pathlib
import random

from folioscope.operators import hash_tree
from folioscope.operators.spread import digest_words, finished_digest, multiset_digest

SCHEMA = "id bigint, part string, value double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def some(n):
    random.seed(n)
    return [(i, random.choice(["a", "b", None]), float(i % 7)) for i in range(n)]


def test_only_differing_ranges_are_read(spark, tmp_path):
    rows = some(3000)
    after = [r for r in rows if r[0] != 17] + [(9000, "new", 1.0)]
    after = [(i, p, -1.0 if i == 40 else v) for i, p, v in after] + [rows[55]]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for bits in (4, 8, 12):
        first, second = f"{one}{bits}", f"{two}{bits}"
        hash_tree.write_snapshot(frame(spark, rows), ["id"], first, bits)
        hash_tree.write_snapshot(frame(spark, after), ["id"], second, bits)
        assert hash_tree.differing_ranges(spark, first, first, bits) == []
        ranges = hash_tree.differing_ranges(spark, first, second, bits)
        wanted = frame(spark, [(i, None, None) for i in (17, 9000, 40, 55)]).select(hash_tree.range_of(["id"], bits).alias("r"))
        assert ranges == sorted({r.r for r in wanted.collect()})
        for folder in (first, second):
            for file in glob.glob(f"{folder}/rows/_range=*/*.parquet"):
                if int(file.split("_range=")[1].split("/")[0]) not in ranges:
                    # Whoever opens a file of another range fails.
                    pathlib.Path(file).write_bytes(b"not parquet")
        found = hash_tree.differing_keys(spark, first, second, SCHEMA, ["id"], bits)
        assert sorted(map(tuple, found.collect())) == [(17, "removed"), (40, "changed"), (55, "changed"), (9000, "added")]
        root = hash_tree.root_digest(spark, second).first()
        assert tuple(root) == tuple(multiset_digest(frame(spark, after), ["id", "part", "value"]).first())


def test_null_keys_empty_and_bounds(spark, tmp_path):
    hash_tree.write_snapshot(frame(spark, [(None, "a", 1.0), (1, "a", None)]), ["id", "part"], str(tmp_path / "n"))
    hash_tree.write_snapshot(frame(spark, []), ["id", "part"], str(tmp_path / "e"))
    found = hash_tree.differing_keys(spark, str(tmp_path / "n"), str(tmp_path / "e"), SCHEMA, ["id", "part"])
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "a", "removed"), (None, "a", "removed")]
    assert hash_tree.differing_ranges(spark, str(tmp_path / "e"), str(tmp_path / "e")) == []
    assert [hash_tree.bits_for(n) for n in (0, 1 << 22, 1 << 23, 1 << 60)] == [4, 4, 8, 16]


def test_digest_from_changes_equals_the_recount(spark, rows):
    columns, by = ["id", "part", "value"], ["part"]
    random.seed(8)
    table = some(400)
    words = digest_words(frame(spark, table), columns, by)
    for _ in range(3):
        gone = random.sample(table, 60)
        came = [(i, "c" if i % 3 else p, v + 1) for i, p, v in gone[:40]] + [(random.randrange(10**6), "d", 0.5)]
        table = [r for r in table if r not in gone] + came
        words = hash_tree.moved_digest(words, frame(spark, gone), frame(spark, came), columns, by)
    assert rows(finished_digest(words), "part", "rows", "digest") == rows(multiset_digest(frame(spark, table), columns, by))
    everything = hash_tree.moved_digest(words, frame(spark, table), frame(spark, []), columns, by)
    assert everything.collect() == []


def test_sides_meet_in_a_named_number_of_tasks(spark, tmp_path):
    rows = some(500)
    hash_tree.write_snapshot(frame(spark, rows), ["id"], str(tmp_path / "one"), 4)
    hash_tree.write_snapshot(frame(spark, rows[:400] + [(5, "b", 9.0)]), ["id"], str(tmp_path / "two"), 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        found = hash_tree.differing_keys(spark, str(tmp_path / "one"), str(tmp_path / "two"), SCHEMA, ["id"], 4)
        kinds = {r["id"]: r["difference"] for r in found.collect()}
        assert kinds == {5: "changed"} | {i: "removed" for i in range(400, 500)}
        # Small partitions as these would be merged into one task.
        assert found.rdd.getNumPartitions() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
