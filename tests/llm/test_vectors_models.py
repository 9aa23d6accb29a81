"""Vector operators against plain versions, models against held-out labels, the pipeline end to end."""

import random
import zlib

import numpy as np
import pytest

from sensorlake.llm import op1_embeddings, op5_toxicity, op9_topk, op10_quality
from sensorlake.llm.components import components, forest
from tests.llm.helpers import ODD, closure, docs, prose

SCHEMA = "vec_id bigint, embedding array<float>, label int, node bigint, n bigint, key string, digest string, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 1, "x", "x", 1) for i, v in rows], SCHEMA)


def cloud(seed, n, d=24, spread=0.08):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n // 3, d))
    return np.vstack([base, base[: n // 4] + spread * r.standard_normal((n // 4, d)), base[: n // 8] * 3, base[:5], np.repeat(base[:1], 20, axis=0) + 0.02 * r.standard_normal((20, d))]).astype(np.float32)


BAD = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]


def plain_links(v, ok, cosine=0.9):
    x = v.astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    return [(a, b) for a in range(len(v)) for b in range(a) if near[a, b]]


@pytest.mark.parametrize("part", [24576, 40])
def test_near_vectors_against_plain(spark, part, monkeypatch):
    monkeypatch.setattr(op1_embeddings, "PART", part)
    v = cloud(1, 300)
    ids = np.random.default_rng(5).permutation(len(v)).tolist()
    rows = [(i, x.tolist()) for i, x in zip(ids, v)] + [(5000 + i, b) for i, b in enumerate(BAD)] + [(6000, [1.0, 0.0]), (6001, [1.0, 0.1])]
    monkeypatch.setattr(op1_embeddings.join, "__defaults__", (0.9, part))
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in op1_embeddings.deduplicate(vectors(spark, rows)).collect()}
    links = plain_links(v, None)
    group = closure(len(v), links)
    least = {}
    for i, g in zip(ids, group):
        least[g] = min(least.get(g, i), i)
    degree = np.zeros(len(v), int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    want = {i: (int(degree[k]), least[group[k]], i == least[group[k]]) for k, i in enumerate(ids)}
    want |= {5000 + i: (0, 5000 + i, True) for i in range(len(BAD))}
    want |= {6000: (1, 6000, True), 6001: (1, 6000, False)}
    assert got == want


def test_near_vectors_odd_tables(spark):
    assert op1_embeddings.deduplicate(vectors(spark, [])).count() == 0
    got = op1_embeddings.deduplicate(vectors(spark, [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1e30, 0.0]), (3, None)])).collect()
    assert len(got) == 6
    assert sorted((g.vec_id, g.n_links, g.component_id) for g in got if g.vec_id is not None) == [(1, 0, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (1000, 999), (999, 1000), (None, 3)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 500 for i in range(501, 540)} | {1000: 999}
    assert components(df.limit(0)).count() == 0
    r = random.Random(1)
    for n in (1, 2, 50):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(n)]
        x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        assert forest(n, x, y).tolist() == closure(n, pairs)


def plain_top(v, ids, query, k=5):
    q = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    s = q @ q[query]
    return sorted((-int(x), i) for j, (x, i) in enumerate(zip(s, ids)) if i != ids[query])[:k]


def test_topk_against_plain(spark):
    v = cloud(2, 400)
    ids = list(range(len(v)))
    rows = [(i, x.tolist()) for i, x in zip(ids, v)] + [(5000 + i, b) for i, b in enumerate(BAD)] + [(6000, [1.0, 2.0]), (6050, [1.0, 2.5]), (None, v[0].tolist())]
    table = vectors(spark, rows)
    got = {}
    for g in op9_topk.search(table, table.where("vec_id % 50 = 0")).collect():
        got.setdefault(g.query_id, []).append((g.rank, -g.score, g.vec_id))
    want = {i: [(r, s, x) for r, (s, x) in enumerate(plain_top(v, ids, i), 1)] for i in ids if i % 50 == 0}
    score = 256 * 256 + 512 * 640
    want |= {6000: [(1, -score, 6050)], 6050: [(1, -score, 6000)]}
    assert {q: sorted(x) for q, x in got.items()} == want


def test_topk_odd_tables(spark):
    empty = vectors(spark, [])
    assert op9_topk.search(empty, empty).count() == 0
    same = vectors(spark, [(i, [1.0, -1.0]) for i in range(100)] + [(50, [1.0, -1.0]), (200, [])])
    got = sorted((g.query_id, g.rank, g.vec_id, g.score) for g in op9_topk.search(same, same.where("vec_id % 50 = 0")).collect())
    assert got == sorted((q, r, i, 131072) for q, ids in ((0, [1, 2, 3, 4, 5]), (50, [0, 1, 2, 3, 4])) for r, i in enumerate(ids, 1))


def test_bit_sliced_sums_are_the_scores():
    r = np.random.default_rng(4)
    for low, high in ((-300, 300), (0, 2), (-5, -4), (-(2**30), 2**30)):
        values = r.integers(low, high, (130, 7))
        block = op9_topk.SlicedBlock(np.arange(130), values)
        for q in (values[0], np.zeros(7, np.int64), np.array([1, -1, 0, 5, 0, 0, -7])):
            slices = op9_topk.score_slices(block, q)
            bits = np.unpackbits(np.ascontiguousarray(slices).view(np.uint8).reshape(len(slices), -1), axis=1, bitorder="little")[:, :130]
            total = sum(bits[i].astype(object) << i for i in range(len(slices)))
            exact = values.astype(object) @ q.astype(object)
            assert len(set((total - exact).tolist())) == 1


def held(sf, column, folds, which, spark):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % folds == which}


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {g.doc_id: g for g in op10_quality.query(spark, sf).collect()}
    want = held(sf, "quality", 5, 0, spark)
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, g in got.items())
    assert np.mean([got[i].predicted == y for i, y in want.items()]) > 0.95
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got.values())


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = held(sf, "toxic", 4, 2, spark)
    got = {g.doc_id: g for g in op5_toxicity.query(spark, sf).where(f"doc_id IN ({','.join(map(str, labels))})").collect()}
    hit = [got[i].predicted for i, y in labels.items() if y]
    false = [got[i].predicted for i, y in labels.items() if not y]
    assert np.mean(hit) > 0.9 and np.mean(false) < 0.02
    assert all(g.held_out for g in got.values())


def test_field_marginals_against_enumeration():
    r = np.random.default_rng(3)
    sizes = np.array([1, 4, 2])
    score, pair = r.standard_normal(7), r.standard_normal((2, 2))
    good, joint = op10_quality.forward_backward(score, sizes, pair)
    at, want, want_joint = 0, [], np.zeros((2, 2))
    for n in sizes:
        p, total = np.zeros(n), 0.0
        local = np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(score[at + i] for i in range(n) if y[i]) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            total += w
            p += w * np.array(y)
            for a, b in zip(y, y[1:]):
                local[a, b] += w
        want.extend(p / total)
        want_joint += local / total
        at += n
    assert np.allclose(good, want) and np.allclose(joint, want_joint)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, None), (None, 1), (99, 1)], "doc_id bigint, quality int")
    table = docs(spark, ODD, extra=True)
    f = op10_quality.fit(table, labels)
    assert op10_quality.score(table, f).count() == len(ODD)
    assert op10_quality.keep_good(table, f).columns == table.columns
    none = op10_quality.fit(table, labels.limit(0))
    assert {r.score for r in op10_quality.score(table, none).collect()} == {0.5}
    assert op10_quality.keep_good(docs(spark, []), f).count() == 0
    assert op10_quality.fit(docs(spark, []), labels).prior == 0.5


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, None), (None, 1)], "doc_id bigint, toxic int")
    table = docs(spark, ODD, extra=True)
    model = op5_toxicity.corpus_model(table)
    got = op5_toxicity.score(table, op5_toxicity.fit(table, labels, model)).collect()
    assert len(got) == len(ODD) and all(0 <= g.score <= 1 for g in got)
    assert {r.score for r in op5_toxicity.score(table, op5_toxicity.fit(table, labels.limit(0), model)).collect()} == {0.5}
    assert op5_toxicity.score(docs(spark, []), op5_toxicity.fit(docs(spark, []), labels, op5_toxicity.corpus_model(docs(spark, [])))).count() == 0


def test_disguised_words_are_restored():
    text = " ".join(["idiot stupid trash loser moron pathetic the and of house"] * 50)
    reader = op5_toxicity.Reader(op5_toxicity.model_of(op5_toxicity.trigram_counts([text])))
    for disguised, plain in {"1d1ot": "idiot", "i.d.i.o.t": "idiot", "iiidiooot": "idiot", "$tupid": "stupid", "tr4$h": "trash", "l0ser": "loser", "p@thetic": "pathetic", "trash!!": "trash", "house$$$": "house", "Étude": "étude"}.items():
        assert reader.of[disguised] == plain
    assert "moron" in reader.words("the m o r o n and") and "moron" in reader.restore("m 0 r 0 n")
    assert reader.words("") == set() == reader.words(None)


def test_doubled_letters_edge_signs_and_spaces_are_decoded():
    text = " ".join(["idiot stupid trash loser moron clown you are a the and of house"] * 50)
    reader = op5_toxicity.Reader(op5_toxicity.model_of(op5_toxicity.trigram_counts([text])))
    doubled = {"mmoron": "moron", "stuupid": "stupid", "iidiot": "idiot", "moronn!": "moron"}
    edges = {"!diot": "idiot", "|oser": "loser", "(lown": "clown", "idio+": "idiot", "(the)": "the", "trash!": "trash", "*house*": "house"}
    for disguised, plain in {**doubled, **edges}.items():
        assert reader.of[disguised] == plain
    for run, plain in {"id iot": "idiot", "you are a i d i o t": "you are a idiot", "mo r on": "moron", "l 0 s e r and": "loser and", "the and of a": "the and of a", "of 12 and 3": "of 12 and 3"}.items():
        assert reader.restore(run).split()[: len(plain.split())] == plain.split()
        assert set(plain.split()) <= reader.words(run)


def test_viterbi_against_enumeration():
    from itertools import product

    model = op5_toxicity.model_of(op5_toxicity.trigram_counts(["idiot trash moron loser"] * 20))

    def cost(options):
        s, total = 0, 0.0
        for c, extra in options:
            total += extra
            if c:
                k = op5_toxicity._code(c)
                total -= model[s * 27 + k] if c != " " or s % 27 else 0.0
                s = s % 27 * 27 + k
        return total - model[s * 27]

    for token in ("1d10t", "m0r.n", "tt1", "a$$b"):
        ways = op5_toxicity.lattice(token)
        best = min(product(*ways), key=cost)
        got = op5_toxicity.viterbi(ways, model)
        assert got == "".join(c for c, _ in best).strip()


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline

    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, sf)
        if name != "tokens":
            assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, table = table, spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = table.count()
        if name in ("quality", "near_duplicates"):
            assert rows[name] < before.count()
        if name == "secrets":
            assert rows[name] == before.count()
            from sensorlake.llm import op6_secrets

            assert not any(op6_secrets.find(r.text) for r in table.select("text").collect())
    assert rows["tokens"] == rows["mixing"]
    assert all(r.n_tokens == len(r.ids) for r in table.collect())


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline

    for name in ("labels",):
        spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{name}.parquet")
    for rows in (ODD, []):
        table = docs(spark, rows, extra=True)
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{name}-{len(rows)}"
            stage(spark, table, str(tmp_path)).write.parquet(path)
            table = spark.read.schema(table.schema).parquet(path) if name != "tokens" else spark.read.parquet(path)


def test_entry_survives_without_the_package(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for p in root.iterdir():
        if p.name not in ("corpus_pipeline.py", "sensorlake") and not p.name.startswith("."):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "sensorlake").mkdir()
    for p in (root / "sensorlake").iterdir():
        if p.name != "llm":
            (tmp_path / "sensorlake" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), [n for n in q if n.startswith('op') or n == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("[]"), out.stderr
    assert prose(1, 3)
