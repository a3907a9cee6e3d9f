import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.llm import packing, tokens

from .helpers import SCHEMA, awkward, clashing, frame


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation_is_a_bijection(n):
    out = tokens.permute(np.arange(n), n)
    assert sorted(out.tolist()) == list(range(n))
    if n >= 1000:
        assert abs(np.corrcoef(np.arange(n), out)[0, 1]) < 0.1
        assert tokens.permute(np.arange(n), n, key=9).tolist() != out.tolist()


def test_round_trip(spark, tmp_path):
    rows = awkward()
    made = tokens.shards(clashing(frame(spark, rows)), length=64, per_shard=50)
    tokens.write_shards(made, str(tmp_path / "shards"))
    held = spark.read.parquet(str(tmp_path / "shards"))
    got = tokens.digest(held).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    encode, by_doc = packing.encoder(packing.default_vocabulary()), defaultdict(list)
    for r in got:
        assert (r["shard"], r["offset"]) == (r["slot"] // 50, r["slot"] % 50 * 128)
        by_doc[r["doc_id"]].append(r)
    records = {r["slot"]: bytes(r["record"]) for r in tokens.read_from(held, 0, 50).collect()}
    for doc, text, *_ in rows:
        ids = np.array([*encode(text or ""), 1], "<u2")
        back = b""
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            part = records[r["slot"]][: 2 * r["length"]]
            assert len(records[r["slot"]]) == 128 and r["ids_crc32"] == zlib.crc32(part)
            back += part
        assert back == ids.tobytes()
    assert [r["slot"] for r in tokens.read_from(held, 77, 50).collect()] == list(range(77, len(got)))


def test_empty_and_repeated(spark):
    assert tokens.shards(spark.createDataFrame([], SCHEMA)).count() == 0
    got = tokens.digest(tokens.shards(frame(spark, [(1, "a", None, None, None)] * 3 + [(None, None, None, None, None)]))).collect()
    assert sorted(r["slot"] for r in got) == [0, 1, 2, 3]


def test_slots_of_sorted_documents_depend_on_them_alone(spark, monkeypatch):
    rows = awkward() + [(1, "another text of the doc_id", None, None, None), (2, "again", None, None, None), (2, "again", None, None, None)]

    def order(docs, parts):
        by = ("doc_id", F.xxhash64("text"))
        held = docs.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        return sorted((r["slot"], str(r["doc_id"]), r["start"], r["ids_crc32"]) for r in tokens.digest(tokens.shards(held, length=64, per_shard=50)).collect())

    first = order(frame(spark, rows), 3)
    assert [r[0] for r in first] == list(range(len(first)))
    assert order(frame(spark, rows[::-1]).repartition(7), 5) == first
    # Shards lie in ranges, in order.
    monkeypatch.setattr(tokens, "TASK_SHARDS", 2)
    parts = tokens.shards(frame(spark, rows), length=64, per_shard=50).select("shard", F.spark_partition_id().alias("part")).collect()
    assert len(parts) > 4 and all(r["part"] == r["shard"] // 2 for r in parts)
