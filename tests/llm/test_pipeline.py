from collections import Counter, defaultdict

import corpus_pipeline as cp
from skirmish.llm import language, packing

from .helpers import SCHEMA, clashing, frame
from .test_jaccard import brute as near
from .test_language import texts
from .test_lines import plain as deduped


def rows():
    out = [(d, t, lang, f"s{d % 3}", len(t)) for d, t, lang, *_ in texts(160)]
    out += [(160 + i, out[i][1], out[i][2], "s0", len(out[i][1])) for i in range(20)]
    block = "\n".join(f"shared line number {i} of the block" for i in range(14))
    out += [(180 + i, out[i + 30][1] + "\n" + block, out[i + 30][2], "s1", None) for i in range(12)]
    out += [(200, None, None, None, None), (201, "", "aa", None, 0), (202, "123 456", "aa", "s0", 7), (203, block, "aa", "s2", 5)]
    return out


def test_stages_against_plain_versions(spark, tmp_path):
    given = frame(spark, rows())
    columns = given.columns
    docs, seen = given, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = [tuple(r) for r in docs.collect()]
        path = str(tmp_path / name)
        stage(spark, docs, None).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        seen[name] = len(after)
        if name == "language_id":
            model = language.train(language.training_rows(given))
            want = [r for r in before if (p := model.predict(r[1]))[0] != "und" and not p[2]]
            assert sorted(map(tuple, after), key=str) == sorted(want, key=str) and len(want) < len(before)
        elif name == "line_dedup":
            plain = deduped(before)
            want = {d: t for (d, _), (t, n) in plain.items() if not (n and not t.strip(" \t\n\x0b\x0c\r"))}
            assert {r["doc_id"]: r["text"] for r in after} == want
            assert any(n for _, n in plain.values()) and all(r[1] is not None for r in before)
        elif name == "ngram_jaccard":
            want = {d for d, (_, root) in near(before).items() if d == root}
            assert {r["doc_id"] for r in after} == want and len(want) < len(before)
        elif name == "mix_sources":
            sizes = {r[0]: len((r[1] or "").split()) for r in before}
            taken = Counter()
            for r in after:
                taken[r["doc_id"]] += len(r["text"].split())
            assert all(n <= 2 * sizes[d] for d, n in taken.items())
            assert abs(sum(taken.values()) / sum(sizes.values()) - 1.5) < 0.1
        else:
            by_sequence = defaultdict(int)
            for r in after:
                by_sequence[r["sequence_id"]] += r["length"]
            encode = packing.encoder(packing.default_vocabulary())
            assert sum(by_sequence.values()) == sum(len(encode(r[1] or "")) + 1 for r in before)
            assert max(by_sequence.values()) <= 2048


def test_stages_take_empty_tables_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        out = stage(spark, empty, None)
        assert out.count() == 0
        if name != "pack_sequences":
            more = clashing(frame(spark, rows()[:40]))
            assert stage(spark, more, None).columns == more.columns
        else:
            assert stage(spark, clashing(frame(spark, rows()[:9])), None).count() > 0
