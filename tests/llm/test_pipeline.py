"""Stages and the whole pipeline against plain Python, and the registered queries on a small folder."""

import random

import duckdb
import pytest

import corpus_pipeline
from quillmesh.llm import decontam, packing, pii, quality, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    words = [f"{a}{b}" for a in "ka lo mi ne pu ra so te".split() for b in "ba de fi go hu".split()]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    items = [(i, text(30)) for i in range(12)]
    docs = [[i, text(r.randint(30, 200)), "en", f"src{i % 3}"] for i in range(240)]
    for i in range(0, 60, 3):
        docs[i][1] = "JUNK!! " * r.randint(20, 60)
    for i in range(100, 120):
        docs[i][1] = docs[i - 30][1]  # copies
    for i in range(130, 140):
        docs[i][1] += " " + items[i % 12][1] + " " + text(10)
    for i in range(150, 170):
        docs[i][1] += f" write to user{i}@mail.example.com or 10.0.0.{i} now"
    docs += [[300, "", "en", "src0"], [301, None, None, None]]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(d[0], int("JUNK" not in (d[1] or "")), 0) for d in docs[:130]], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), docs, items


def test_stages_against_plain_python(spark, folder, tmp_path):
    path, docs, items = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    kept = {d[0]: d[1] for d in docs}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = dict(kept)
        if i == 0:
            model = quality.fit(spark, frame, spark.read.parquet(f"{path}/labels.parquet"))
            scores = quality.vote(model, quality.embed(model, [t or "" for t in kept.values()]))
            kept = {d: t for (d, t), s in zip(kept.items(), scores, strict=True) if s >= quality.THRESHOLD}
            assert all("JUNK" not in (t or "") for t in kept.values()) and len(kept) == len(docs) - 20
        elif i == 1:
            def shingles(text):
                w = (text or "").lower().split()
                k = min(5, len(w))
                return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()

            sets = {d: shingles(t) for d, t in kept.items()}
            label = {d: d for d in kept}
            ids, changed = list(kept), True
            while changed:
                changed = False
                for a, x in enumerate(ids):
                    for y in ids[:a]:
                        if label[x] != label[y] and (sets[x] == sets[y] or 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])):
                            label[x] = label[y] = min(label[x], label[y])
                            changed = True
            kept = {d: t for d, t in kept.items() if label[d] == d}
        elif i == 2:
            index = decontam.Index(items)
            kept = {d: t for d, t in kept.items() if not index.leaks(t or "")}
            assert {d for d in before if 130 <= d < 140}.isdisjoint(kept)
        else:
            model = pii.fit(spark, frame)
            kept = {d: pii.redact_text(t, pii.find([t], model)[0]) if t else t for d, t in kept.items()}
            assert not any("@mail" in (t or "") for t in kept.values())
        out = f"{tmp_path}/{i}"
        stage(spark, frame, path).write.parquet(out)
        frame = spark.read.parquet(out)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert {r["doc_id"]: r["text"] for r in frame.collect()} == kept, name
    assert all(r["n_chars"] == len(r["text"] or "") for r in frame.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, path).toPandas()
    assert packed.length.sum() == sum(len(packing.token_ids(t or "")) for t in kept.values())
    whole = corpus_pipeline.run(spark, path).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert whole[key].sort_values(key).values.tolist() == packed[key].sort_values(key).values.tolist()


COLUMNS = {
    "op1_decontamination": {"doc_id": "bigint", "item_id": "bigint", "score": "double"},
    "op2_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op5_language_model": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op9_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_licenses": {"doc_id": "bigint", "license": "string", "coverage": "double", "start": "bigint", "end": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_queries_have_the_columns_and_rows_of_their_contract(spark, folder, name):
    path, docs, _ = folder
    assert set(COLUMNS) == set(queries.queries())
    got = queries.queries()[name](spark, path)
    assert COLUMNS[name].items() <= dict(got.dtypes).items()
    rows = got.collect()
    ids = sorted(d[0] for d in docs)
    if name in ("op1_decontamination", "op10_licenses"):
        assert {r["doc_id"] for r in rows} <= set(ids)
        assert name == "op10_licenses" or {d for d in range(130, 140)} <= {r["doc_id"] for r in rows}
    elif name == "op6_packing":
        assert {r["doc_id"] for r in rows} == set(ids)
        for s in {r["sequence_id"] for r in rows}:
            at = 0
            for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 2048
    else:
        assert sorted(r["doc_id"] for r in rows) == ids and all(v is not None for r in rows for k, v in r.asDict().items() if k in COLUMNS[name] and k != "grown_shard")


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_stages_on_empty_and_odd_tables(spark, tmp_path, case):
    """Empty tables; null and repeated ids, null, empty and very long texts, and extra columns whose names the stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept_id long, h long, `_label` int, spans string, sequence_id long"
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(r.choice(words) for _ in range(60_000))
    texts = [(1, "some plain words stand here"), (1, "some plain words stand here"), (1, "others"), (None, "no id at all"), (None, None), (2, None), (3, ""), (4, long), (5, long + " a@b.cd"), (6, " \n "), (7, "mail x@y.zz")]
    rows = [] if case == "empty" else [(d, t, None, None, None, 0.5, 1, 2, 0, "s", 3) for d, t in texts]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        frame = spark.read.parquet(f"{tmp_path}/{i}")
        assert frame.columns == [c.split()[0].strip("`") for c in schema.split(", ")], name
    kept = sorted((str(x["doc_id"]), len(x["text"] or "")) for x in frame.collect())
    if case == "empty":
        assert kept == []
    else:  # one row of id 1, of the empty texts, and of the two long ones
        assert [k for k, _ in kept] == ["1", "2", "4", "7", "None"], kept
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len(kept) and "sequence_id" in packed.columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, folder, name):
    path = folder[0]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = queries.queries()[name](spark, path)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(found.fetchall())
