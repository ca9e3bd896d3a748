"""Whole operators against plain Python: scores, rates, stored bytes, recall, and the pipeline; and columns of any name."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fieldspark.llm import common, html_extract, lines, linking, media, mixing, ngram_join, packing, pii, quality, secrets, toxicity

WORDS = [a + b for a in ("ka", "lo", "mi", "ren", "tu") for b in ("sa", "ved", "non", "ix", "ar", "ole", "um")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def brute_scores(texts: dict, labels: dict, k: int = toxicity.K) -> dict:
    """(score, [(example, similarity)]) of each text, with dense vectors and no index."""
    words = {i: toxicity.terms_of(t) for i, t in texts.items()}
    examples = sorted(i for i, y in labels.items() if texts.get(i))
    vocabulary = sorted({w for i in examples for w in words[i]})
    at = {w: j for j, w in enumerate(vocabulary)}
    df = Counter(w for ws in words.values() for w in set(ws))
    n1 = sum(labels[i] for i in examples)
    n0, n = len(examples) - n1, len(examples)
    weight = np.zeros(len(vocabulary))
    for w, j in at.items():
        b = sum(labels[i] for i in examples if w in words[i])
        a = sum(1 - labels[i] for i in examples if w in words[i])
        down = (a + b) * (n - a - b) * n0 * n1
        chi2 = n * (a * (n1 - b) - b * (n0 - a)) ** 2 / down if down else 0
        weight[j] = (math.log((1 + len(texts)) / (1 + df[w])) + 1) * (1 + max(0, chi2 - toxicity.SIGNIFICANT))

    def vector(ws):
        v = np.zeros(len(vocabulary))
        for w, c in Counter(ws).items():
            if w in at:
                v[at[w]] = (1 + math.log(c)) * weight[at[w]]
        size = math.sqrt((v * v).sum())
        return v / size if size else v

    matrix = np.stack([vector(words[i]) for i in examples])
    y = np.array([labels[i] for i in examples], float)

    def nearest(v, skip=-1):
        s = matrix @ v
        if skip >= 0:
            s[skip] = 0
        order = [j for j in np.lexsort((np.arange(n), -np.round(s, 12)))[: k] if s[j] > 1e-15]
        return order, s[order]

    def vote(j, s):
        return float((s**2 * y[j]).sum() / (s**2).sum())

    prior, votes, none = y.mean(), [], []
    for e in range(n):
        j, s = nearest(matrix[e], e)
        if j:
            votes.append((vote(j, s), y[e]))
        else:
            none.append(y[e])
    pools = []
    for x, label in sorted(votes):
        pools.append([1, x, label])
        while len(pools) > 1 and pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    xs, ys = [p[1] / p[0] for p in pools], [(p[2] + prior) / (p[0] + 1) for p in pools]
    out = {}
    for i, ws in words.items():
        j, s = nearest(vector(ws))
        out[i] = (float(np.interp(vote(j, s), xs, ys)) if j else (sum(none) + prior) / (len(none) + 1), [(examples[e], float(x)) for e, x in zip(j, s, strict=True)])
    return out


def test_toxicity_equals_brute_force(spark):
    r = random.Random(12)
    texts = {i: prose(r, r.choice([1, 5, 40, 300])) + (" vile, NASTY" * r.randint(1, 3) if i % 7 == 0 else "") for i in range(400)} | {400: "", 401: "zzz unknown", 402: "Vile!"}
    labels = {i: int(i % 7 == 0) for i in range(0, 300, 2)} | {400: 1}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labelled = spark.createDataFrame([(i, y) for i, y in labels.items()] + [(3, None), (None, 1), (9999, 1)], "doc_id long, label int")
    index, ids = toxicity.fit(docs, labelled)
    want = brute_scores(texts, labels)
    for x in toxicity.score(docs, index, ids).collect():
        score, near = want[x.doc_id]
        assert math.isclose(x.score, score, abs_tol=1e-9), x.doc_id
        assert np.allclose([e.similarity for e in x.evidence], [s for _, s in near], atol=1e-9) and all(e.label == labels[e.example] for e in x.evidence)
        assert {e.example for e in x.evidence if e.similarity > near[-1][1] + 1e-9} == {i for i, s in near if s > near[-1][1] + 1e-9}


def test_toxicity_bounds_are_of_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 10) for i in range(50)], "doc_id long, text string")
    labelled = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    assert len(toxicity.fit(docs, labelled, examples=20)[1]) == 20
    assert 0 < len(toxicity.fit(docs, labelled, example_bytes=200)[1]) < 10
    twice = docs.unionByName(spark.createDataFrame([(3, "a"), (3, None)], "doc_id long, text string"))
    index, ids = toxicity.fit(twice, labelled)
    assert b"a" in index.vocabulary and ids.count(3) == 1 and b"w3" not in index.vocabulary


def test_mixing_equals_brute_force(spark):
    r = random.Random(6)
    own = {"a": WORDS[:14], "b": WORDS[10:24], "c": WORDS[20:]}
    rows = [(i, " ".join(r.choice(own[g]) for _ in range(r.randint(0, 40))), g) for i, g in enumerate(r.choices("abc", (6, 3, 1), k=300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, g string")
    model = mixing.train(df, df.select("doc_id", "g"), domain="g")

    def bucket(w):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        return (h - (1 << 64) if h >> 63 else h) % mixing.BUCKETS

    counts = np.zeros((3, mixing.BUCKETS))
    for _, t, g in rows:
        for w in t.split():
            counts["abc".index(g), bucket(w)] += 1
    total = counts.sum(1, keepdims=True)
    logs = np.round(np.log((counts + 0.5) / (total + 0.5 * mixing.BUCKETS)), 3)
    assert model.domains == ["a", "b", "c"] and np.allclose(model.word, logs, atol=2e-3) and np.allclose(model.prior, total[:, 0] / total.sum())
    post, n = [], []
    for _, t, _ in rows:
        b = [bucket(w) for w in t.split()]
        s = logs[:, b].sum(1) * min(len(b), mixing.EVIDENCE) / max(len(b), 1) + np.log(total[:, 0] / total.sum())
        e = np.exp(s - s.max())
        post.append(np.round(e / e.sum(), 6))
        n.append(len(b))
    p, n = np.stack(post), np.array(n, float)
    for weights, floor in (({"a": 1, "b": 1, "c": 2}, 0.0), (None, 0.5), ({"a": 1, "b": 0, "c": 0}, 0.0)):
        now = n @ p
        whole = now.sum()
        share = now / whole
        want = np.array([weights[d] for d in "abc"], float) if weights else share**mixing.FLATTEN
        want /= want.sum()
        targets = want * (whole if not floor else whole * max(floor * share[want > 0] / want[want > 0]))
        rate = np.ones(len(n))
        for _ in range(20_000):
            residual = ((rate * n) @ p - targets) / (whole * share)
            rate = np.maximum(floor, rate * (1 - mixing.MU) - p @ residual + mixing.MU)
        got = mixing.rates(df, df.select("doc_id", "g"), domain="g", weights=weights, floor=floor).orderBy("doc_id").toPandas()
        assert np.allclose(np.stack(got.posterior), p, atol=2e-6) and (got.n_tokens == n).all()
        mine, best = ((x * n) @ p for x in (got.rate.to_numpy(), rate))
        assert (got.rate >= floor).all() and np.abs(mine - best).max() < 5e-3 * whole
        objective = lambda x: ((((x * n) @ p - targets) ** 2) / (whole * whole * share)).sum() + mixing.MU * (n * (x - 1) ** 2).sum() / whole  # noqa: E731, B023
        assert objective(got.rate.to_numpy()) <= objective(rate) + 1e-5
        assert ((got.copies - got.rate).abs() < 1).all()


def test_mixing_reports_targets_that_are_not_met(spark, monkeypatch, caplog):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "c d e", "y")], "doc_id long, text string, g string")
    model = mixing.train(df, df.select("doc_id", "g"), domain="g")
    scored = mixing.with_posteriors(df, model, "text", "n", "p")
    assert mixing.fit_rates(scored, model.domains, "n", "p", {"x": 5, "y": 1})[1]["met"]
    monkeypatch.setattr(mixing, "ITERATIONS", 0)
    report = mixing.fit_rates(scored, model.domains, "n", "p", {"x": 5, "y": 1})[1]
    assert not report["met"] and not report["at_rest"] and report["iterations"] == 0
    mixing.rates(df, df.select("doc_id", "g"), domain="g", weights={"x": 5, "y": 1})
    assert "not met" in caplog.text


def test_media_rows_equal_plain_bytes(spark):
    texts = {1: None, 2: "", 3: "a" * 63, 4: "a" * 64, 5: "é😀" * 40, 6: "x\0y" * 30_000}
    for r in media.media_features(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        a = np.frombuffer(payload, np.uint8).astype(np.int64)
        levels = "".join(f"{int(((a >> 4) == k).sum()) * 255 // len(a):02x}" for k in range(16))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and media.samples(stored) == payload
        assert r.feature == f"{levels}:{int(a.sum()) * 100 // len(a)}:{int(a.std() * 100 + 1e-9)}"


def test_line_recall_is_measured(sf_dir, capsys):
    """Lines of documents whose id is divisible by 50, against all lines of a tenth of the largest table: pairs at the threshold that share a band."""
    table = pq.read_table(sf_dir.replace("0.001", "0.01") + "/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    every, asked = {}, set()
    for row in table:
        for raw in (row["text"] or "").split("\n"):
            if line := lines.normal(raw):
                every.setdefault(line, len(every))
                if row["doc_id"] % 50 == 0:
                    asked.add(every[line])
    names = list(every)
    sets = lines.shingle_sets(names)
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for h in s.tolist():
            where[h].append(i)
    keys = np.concatenate([lines.band_keys(lines.signatures(*lines.char_hashes([names[k] for k in part]))) for part in lines._parts(list(range(len(names))), dict(enumerate(names)))])
    pairs = found = 0
    for i in sorted(asked):
        both = Counter(j for h in sets[i].tolist() for j in where[h])
        for j, n in both.items():
            if j != i and 100 * n >= lines.PERCENT * (len(sets[i]) + len(sets[j]) - n):
                pairs += 1
                found += bool((keys[i] == keys[j]).any())
    with capsys.disabled():
        print(f"\nrecall of line pairs: {found} of {pairs}")
    assert pairs > 20 and found / pairs >= 0.9


CLASH = ["__gone", "__key", "__parts", "__counts", "__several", "__row", "__doc", "__node", "__n", "__p", "__c", "__b", "__s", "__host", "__low", "node", "root", "key", "block", "payload", "line", "hub", "proof", "gone", "left", "a b", "place", "n"]


@pytest.fixture(scope="module")
def clashing(spark):
    r = random.Random(8)
    texts = [prose(r, 80) + "\nshared line of text that is long enough\n" + prose(r, 30) for _ in range(8)]
    texts += [texts[0], texts[1].replace("ka", "KA", 1), "", None, "x", "same line here\n" * 3]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)] + [(None, texts[2], "en")], "doc_id long, text string, lang string")
    return df.select("*", *[F.lit("c").alias(c) for c in CLASH])


def test_columns_of_any_name_stay(clashing):
    n = clashing.count()
    for out in (
        lines.dedup_lines(clashing), ngram_join.keep_one(clashing), quality.keep_good(clashing, rules=(quality.BASE[1],)), mixing.mix(clashing, clashing.select("doc_id", "lang"), domain="lang", floor=1.0),
    ):
        assert out.columns == clashing.columns and 0 < out.count()
        assert {x for row in out.select(*[F.col(f"`{c}`") for c in CLASH]).distinct().collect() for x in row} == {"c"}
    for out, name in ((pii.find_pii(clashing), "pii"), (secrets.find_secrets(clashing), "secrets"), (quality.judge(clashing), "quality"), (html_extract.extract(clashing.withColumn("html", F.col("text")), url="lang"), "text")):
        assert out.count() == n and name in out.columns and set(CLASH) <= set(out.columns)
    assert ngram_join.components_of(clashing).count() == n == lines.line_report(clashing).count() == media.media_features(clashing).count()
    assert packing.pieces(clashing, public_tokenizers.path("word_bpe_49k.json")).select("doc_id").distinct().count() == n


def test_only_local_sessions_may_lack_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_hot_keys_meet_by_broadcast(spark):
    rows = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(3000)] + [(-1, None)], "id long, k long")
    counts = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).select("k", "n", (F.col("k") * 2).alias("v"))
    got = {r.id: r.v for r in common.matched(rows, counts, "k", "n", 3001).collect()}
    assert got == {i: (1 if i % 3 else i) * 2 for i in range(3000)} | {-1: None}


# the pipeline


def _good(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    at = defaultdict(list)
    for k in range(len(w) - 2):
        at[tuple(w[k : k + 3])].append(k)
    repeats = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)})
    ls = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
    chars, letters = sum(map(len, w)), [c for c in t or "" if c.isalpha()]
    return (
        len(w) >= 50 and 100 * repeats <= 50 * len(w) and symbols / max(len(w), 1) <= 0.15 and 2.0 <= chars / max(len(w), 1) <= 14.0
        and sum(c.isupper() for c in letters) / max(len(letters), 1) <= 0.3 and (len(ls) - len(set(ls))) / max(len(ls), 1) <= 0.5
    )


def _components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(n)]


def brute_first_stages(rows):
    """What the first three stages leave: (doc_id, text)."""
    rows = [(i, t) for i, t in rows if _good(t)]
    own = [(i, k, x) for i, t in rows if i is not None for k, x in enumerate(t.split("\n")) if x.split()]
    names = sorted({lines.normal(x) for _, _, x in own})
    sets = lines.shingle_sets(names)
    top = dict(zip(names, _components(len(names), lambda a, b: linking.similar(sets[a], sets[b], lines.PERCENT)), strict=True))
    first = {}
    for i, k, x in own:
        first[top[lines.normal(x)]] = min(first.get(top[lines.normal(x)], (i, k)), (i, k))
    left = []
    for i, t in rows:
        if i is None:
            left.append((i, t))
        elif (s := "\n".join(x for k, x in enumerate(t.split("\n")) if not x.split() or first[top[lines.normal(x)]] == (i, k))).strip():
            left.append((i, s))

    def grams(t):
        w = t.lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])

    g = [grams(t) for _, t in left]
    of = _components(len(left), lambda a, b: left[a][0] is not None and left[b][0] is not None and 100 * len(g[a] & g[b]) >= 80 * len(g[a] | g[b]))
    kept = {}
    for k, (i, t) in enumerate(left):
        if i is None:
            kept[-1 - k] = (i, t)
        else:
            kept[of[k]] = min(kept.get(of[k], (i, t)), (i, t))
    return sorted(kept.values(), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(21)
    rows = [(None, prose(r, 70)), (1, None), (2, ""), (3, "few words"), (4, "AB CD " * 60), (5, "same words again " * 60)]
    for k in range(14):
        t = prose(r, 60) + "\n" + prose(r, 40)
        rows += [(10 + 3 * k, t), (11 + 3 * k, t), (12 + 3 * k, prose(r, 55) + "\n" + t.split("\n")[1])]
        w = t.split(" ")
        w[5] = "other"
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame([(i, t, ("en", "de")[(i or 0) % 2], f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = common.stored(stage(spark, at, str(tmp_path)), name.replace(" ", "-"))
    got = sorted(((x.doc_id, x.text) for x in at.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert got == brute_first_stages(rows)
    assert all(x.n_chars == len(x.text) for x in at.collect())
    mixed = corpus_pipeline.mix_domains(spark, at, str(tmp_path))
    copies = Counter((x.doc_id, x.text) for x in mixed.collect())
    assert mixed.columns == df.columns and set(copies) == set(got)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = Counter()
    for x in pieces:
        tokens[x.doc_id] += x.length
    assert tokens == Counter({i: sum(len(t.encode(s, add_special_tokens=False).ids) + 1 for (j, s), c in copies.items() if j == i for _ in range(c)) for i, _ in got})
    empty = spark.createDataFrame([], df.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
