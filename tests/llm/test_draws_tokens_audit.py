"""Resampling, transducer and divergence audit against plain versions and the libraries, on odd rows and on the tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlake.llm import op6_secrets, op7_simhash, op9_topk, op11_resampling, op12_transducer, op13_divergence
from tests.compare import compare, duck
from tests.llm.helpers import ODD, docs, prose

A_TO_Z = {c: c + 32 for c in range(65, 91)}


# -- op11 ------------------------------------------------------------------------------------------


def plain_resample(rows, target, percent=10, least=20, longest=1, buckets=10_000):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(A_TO_Z))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(place, runs(words(r[1]))))
    for x in target:
        t.update(map(place, runs(words(x))))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for r in rows:
        w = words(r[1])
        f = runs(w)
        weight = sum(gain(place(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append((r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)))
    able = sorted((o for o in out if o[4] >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1]))
    drawn = [(*o[:4], i) for i, o in enumerate(able[: percent * len(able) // 100], 1)]
    rest = Counter(o[:4] for o in out) - Counter(d[:4] for d in drawn)
    return Counter(drawn) + Counter({(*o, None): n for o, n in rest.items()})


def _texts(n, seed=0):
    r = random.Random(seed)
    return [(i, prose(i, r.randint(0, 60), 3000) + r.choice(["", " É1 Zwölf 字", " UPPER-case"])) for i in range(n)]


@pytest.mark.parametrize(("longest", "few"), [(1, 4096), (1, 3), (3, 8)])
def test_resampling_against_plain(spark, monkeypatch, longest, few):
    monkeypatch.setattr(op11_resampling, "FEW", few)
    rows = _texts(400) + [(7, prose(7, 30)), (7, prose(7, 30)), (7, prose(8, 40)), (None, prose(9, 50)), (None, prose(9, 50)), (9, None), (10, "")]
    target = [prose(i, 25, 60) for i in range(20)] + [None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = op11_resampling.resample(docs(spark, rows, extra=True).repartition(5), bench, percent=30, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(g) for g in got.collect()) == plain_resample(rows, target, percent=30, longest=longest)


def test_resampling_odd_tables(spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    got = op11_resampling.resample(docs(spark, ODD), bench).collect()
    assert Counter(tuple(g) for g in got) == plain_resample(ODD, ["one two"])
    assert op11_resampling.resample(docs(spark, []), bench).count() == 0
    rows = _texts(60)
    assert Counter(tuple(g) for g in op11_resampling.resample(docs(spark, rows), bench.limit(0)).collect()) == plain_resample(rows, [])


def test_cutoff_is_the_key_at_its_place_and_discards_an_eighth(spark):
    r = random.Random(4)
    rows = [(r.choice([0, 0, 0, 5, r.randint(-9, 9)]), int(r.random() < 0.1), r.randint(0, 3), 1, i) for i in range(3000)]
    keys = spark.createDataFrame(rows, "neg bigint, no_id int, doc_id bigint, n_features bigint, row bigint").repartition(7)
    order = sorted(rows)
    passes = []
    for k in (1, 2, 700, 1500, 2999, 3000):
        assert op11_resampling.cutoff(keys, k, few=5, told=lambda a, b: passes.append((a, b))) == order[k - 1]
    assert passes and all(b <= a - a / 8 + 1 for a, b in passes)
    assert op11_resampling.cutoff(keys, 0) is None


def test_many_partitions_merge_their_medians(spark, monkeypatch):
    monkeypatch.setattr(op11_resampling, "MEDIANS", 2)
    rows = [(i * 7919 % 1000, 0, i, 1, i) for i in range(1000)]
    keys = spark.createDataFrame(rows, "neg bigint, no_id int, doc_id bigint, n_features bigint, row bigint").repartition(6)
    assert op11_resampling.cutoff(keys, 321, few=4) == sorted(rows)[320]


# -- op12 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    t = op12_transducer.transducer(*op12_transducer.vocabulary())
    return tiktoken.Encoding("own", pat_str=op12_transducer.vocabulary()[1], mergeable_ranks=t.ranks, special_tokens={})


def test_transducer_agrees_with_library(tik):
    t = op12_transducer.transducer(*op12_transducer.vocabulary())
    r = random.Random(3)
    letters = " \t\n\r\x0b\x1c\x85 'stredmvlaeiou Aé1²½.!<|endoftext|>字́🙂ࢯ\U000323b0\x00　العربيةрусский"
    for _ in range(6000):
        s = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        ids = t.encode(s)
        assert ids == tik.encode_ordinary(s)
        assert b"".join(t.decode(ids)) == s.encode()
    for s in ("a" * 50_000, "abcdefghij" * 5000, " " * 30_000, "字é" * 9000, "".join(r.choice("abcdefghijklmnop") for _ in range(20_000))):
        assert t.encode(s) == tik.encode_ordinary(s)


def test_every_token_alone_is_encoded_as_the_library_does(tik):
    t = op12_transducer.transducer(*op12_transducer.vocabulary())
    for token, rank in list(t.ranks.items())[::7]:
        assert t.piece(token) == (rank,)  # a piece that is a token as a whole
        s = token.decode("utf-8", "ignore")
        assert t.encode(s) == tik.encode_ordinary(s)


def test_forgotten_states_change_nothing(tik, monkeypatch):
    for name, n in (("STATES", 30), ("PAIRS", 10), ("PIECES", 5)):
        monkeypatch.setattr(op12_transducer, name, n)
    t = op12_transducer.Transducer(op12_transducer.transducer(*op12_transducer.vocabulary()).ranks, op12_transducer.vocabulary()[1])
    text = prose(1, 300) + " unbelievable Zwölfkämpfer 'll  字字 the the"
    assert t.encode(text) == tik.encode_ordinary(text)
    assert len(t.states) <= 31


def test_transducer_against_merges_of_odd_vocabularies():
    """Vocabularies no training would give: ranks in any order, tokens that merges never reach."""
    import tiktoken

    r = random.Random(8)
    for _ in range(60):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 256 + 25:
            tokens.add(bytes(r.choices(b"abc", k=r.randint(2, 6))))
        high = [t for t in tokens if len(t) > 1]
        r.shuffle(high)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(high)}
        t = op12_transducer.Transducer(ranks, r"[a-c]+|\s+")
        lib = tiktoken.Encoding("odd", pat_str=r"[a-c]+|\s+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(60):
            s = "".join(r.choices("abc ", weights=[4, 4, 4, 1], k=r.randint(0, 40)))
            assert t.encode(s) == lib.encode_ordinary(s)


def test_lookahead_is_bounded(tik):
    t = op12_transducer.transducer(*op12_transducer.vocabulary())
    longest = max(map(len, t.ranks))
    raw = "".join(random.Random(5).choice("etaoinshrdl") for _ in range(4000)).encode()
    s, read, out = t.start, 0, 0
    for b in raw:
        s, emitted = s[b]
        read += 1
        out += sum(len(t.bytes_of[i]) for i in emitted)
        assert read - out <= 4 * longest


def test_decoding_streams_whole_characters():
    u, r = op12_transducer.Utf8(), random.Random(2)
    for _ in range(5000):
        raw = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82, 0xFF, 0xED, 0xA0]) for _ in range(r.randint(0, 12)))
        cuts = sorted(r.randint(0, len(raw)) for _ in range(3))
        parts = [raw[x:y] for x, y in zip([0, *cuts], [*cuts, len(raw)])]
        got = list(u.stream(parts))
        assert b"".join(got) == raw
        assert "".join(g.decode("utf-8", "replace") for g in got) == raw.decode("utf-8", "replace")


def test_transducer_odd_rows(spark, tik):
    v = op12_transducer.vocabulary()
    want = sorted((str(i), len(ids := tik.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ODD)
    got = op12_transducer.round_trip(docs(spark, ODD, extra=True), *v).collect()
    assert sorted((str(g.doc_id), g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got) == want
    ids = op12_transducer.encode(docs(spark, ODD), *v)
    assert sorted(r.text for r in op12_transducer.decode(ids, *v).collect()) == sorted(t or "" for _, t, _ in ODD)
    assert [r.text for r in op12_transducer.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), *v).collect()] == [""]
    assert op12_transducer.round_trip(docs(spark, []), *v).count() == 0


def test_transducer_query_covers_the_table(spark, sf, tik):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {g.doc_id: g for g in op12_transducer.query(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = tik.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


# -- op13 ------------------------------------------------------------------------------------------


def plain_audit(rows, min_docs=30, top=50):
    """rows of (text, lang, source)"""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    n, held, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = term.findall((text or "").translate(A_TO_Z))
        n.update((lang, source, t) for t in found)
        held.update((lang, t) for t in set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), d in held.items() if x == lang and d >= min_docs]
        share = lambda c, total: 1 + 1_000_000_000 * (c + 5) // (total + 5 * len(kept))
        count = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        p = {s: {t: share(c, sum(count[s].values())) for t, c in count[s].items()} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        q = {t: share(c, sum(whole.values())) for t, c in whole.items()}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for i, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, i))
    return sorted(out)


SPOKEN = "doc_id bigint, text string, lang string, source string"


def _spoken(n, seed=1):
    r = random.Random(seed)
    rows = [(i, prose(i, r.randint(0, 40), 90).replace("w1", "É").replace("w2", "Xy-"), r.choice(["en", "en", "de", None]), r.choice([f"s{r.randrange(9)}", "hot", None, ""])) for i in range(n)]
    return rows + [(1, None, "en", "silent"), (1, "", "fr", "only"), (2, "7 8 !", "xx", "a"), (3, None, "xx", "b"), (4, "字 字 Ä", "en", "hot")] * 2


@pytest.mark.parametrize(("block", "rows", "top"), [(128, 300_000, 50), (2, 40, 3)])
def test_audit_against_plain(spark, monkeypatch, block, rows, top):
    monkeypatch.setattr(op13_divergence, "BLOCK", block)
    monkeypatch.setattr(op13_divergence, "SLICE_ROWS", rows)
    data = _spoken(500)
    df = spark.createDataFrame(data, SPOKEN).repartition(4)
    for name in ("term", "n", "docs", "p", "q", "kept", "number", "a", "b", "part", "value", "rank", "item"):
        df = df.withColumn(name, F.lit("x"))
    got = op13_divergence.audit(df, min_docs=8, top=top)
    assert sorted(tuple(g) for g in got.collect()) == plain_audit([d[1:] for d in data], 8, top)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_audit_odd_tables(spark):
    assert op13_divergence.audit(spark.createDataFrame([], SPOKEN)).count() == 0
    got = op13_divergence.audit(docs(spark, ODD)).collect()
    assert sorted(tuple(g) for g in got) == plain_audit([(t, "en", s) for _, t, s in ODD])


def test_terms_are_those_of_the_pattern():
    s = "".join(map(chr, range(0x250))) + "AbC 字🙂-x"
    assert [t.decode() for t in op13_divergence.terms_of(s)] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", s.translate(A_TO_Z))


@pytest.mark.parametrize("name", ["op11", "op13"])
def test_queries_agree_with_sql(spark, sf, name):
    module = {"op11": op11_resampling, "op13": op13_divergence}[name]
    assert compare(module.query(spark, sf), duck(sf), module.SQL) == []


# -- earlier operators on rows that they used to fail on -----------------------------------------------


def test_topk_with_components_of_any_size(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([1e30, -1e30, 3e38, 0.25, -7.0, 2.0**33, 1e-3]) if i % 3 else r.uniform(-1, 1) for _ in range(4)]) for i in range(90)]
    rows += [(90, [float(2**31)] * 4), (91, [float(2**31) + 0.5] * 4), (92, [1e300, 0.0, -1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(g.query_id, g["rank"]): (g.vec_id, g.score) for g in op9_topk.search(df, df.where("vec_id % 7 = 0 OR vec_id > 89")).collect()}
    exact = [[math.floor(256 * x) if abs(x) < 2**40 else int(x) * 256 for x in v] for _, v in rows]
    limit = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = {}
    for q, _ in rows:
        if q % 7 == 0 or q > 89:
            best = sorted((-sum(a * b for a, b in zip(exact[q], exact[c])), c) for c, _ in rows if c != q)[:5]
            want |= {(q, i): (c, limit(-s)) for i, (s, c) in enumerate(best, 1)}
    assert got == want


def test_sortable_bytes_have_the_order_of_numbers():
    r = random.Random(1)
    numbers = sorted({r.choice([-1, 1]) * r.getrandbits(r.choice([1, 3, 8, 9, 63, 64, 200])) for _ in range(800)})
    assert sorted(numbers, key=op9_topk.sortable) == numbers


def test_secret_urls_in_long_runs():
    plain = re.compile(r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@")
    r = random.Random(9)
    for _ in range(4000):
        s = "".join(r.choice(["a", "z", "9", "+", "://", ":", "/", "@", " ", "A", "ftp://u:p@", "é"]) for _ in range(r.randint(0, 25)))
        assert op6_secrets.url_credentials(s) == [m.span() for m in plain.finditer(s)]
    start = time.monotonic()
    assert op6_secrets.find("a" * 1_000_000 + " x://" + "b" * 1_000_000 + ":c")[:1] != []  # the run of hex digits
    assert op6_secrets.find("q" * 1_000_000 + "://u:p@h " + "://" * 100_000) == [(0, 1_000_007, "urlauth")]
    assert time.monotonic() - start < 5


def test_one_row_of_each_component_stays(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(4, a), (6, a), (6, b), (None, b), (None, c), (None, c), (7, None), (8, ""), (9, prose(4, 60)), (9, prose(5, 60)), (3, a), (3, a)]
    kept = op7_simhash.keep_first(docs(spark, rows, extra=True))
    assert sorted((str(k.doc_id), k.text or "") for k in kept.collect()) == sorted([("3", a), ("6", b), ("None", c), ("7", ""), ("9", prose(4, 60)), ("9", prose(5, 60))])
    assert kept.columns == docs(spark, [], extra=True).columns
    assert op7_simhash.keep_first(docs(spark, [])).count() == 0
