"""The corpus operators against brute force, on the smallest tables and on a table of odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.util import assert_same
from tidemark.llm import exact_dedup, language_id, language_model, mixing, near_dedup, packing, personal_data, registry, token_counts, token_shards, vector_search
from tidemark.llm.common import documents

PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} and" for i in range(40_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2
ODD = [
    (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "a", "en"), (5, "A b c d", None), (6, "a b c d e f", "en"), (7, "a  b c\nd e f ", "en"),
    (8, "12 34 !!", "fr"), (9, "ﬁ İ ΣΑΣ 日本語。テキスト ▁x <|endoftext|> </s>", "fr"), (10, LONG, "en"), (11, LONG, "en"), (12, BASE, "en"), (13, BASE + "extra words at the end", "en"), (14, BASE, "fr"),
    (15, "mail a.b@c.de, call +49 (30) 1234-5678 or 192.168.1.300 and 10.0.0.1 card 4111 1111 1111 1111", "en"), (16, "x" * 50_000, "en"), (17, "don't it's I'LL 1,5 '' \u0000", "en"),
    (18, "the cat sat on the mat with the hat", "en"), (19, "le chat est sur la table avec le chien", "fr"), (None, "a row without id", "en"), (4, "a", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string")
    return df.withColumn("n_tokens", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("rep", F.lit(3)).withColumn("source", F.lit(None).cast("string")).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def pdocs():
    return pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id").text


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, oracle, name):
    assert_same(registry.queries()[name](spark, DATA).toPandas(), oracle(registry.oracle_sql()[name]))


# ---- token counts


def test_token_counts(spark, odd, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = registry.queries()["op1_token_counts"](spark, DATA).toPandas().set_index("doc_id")
    texts = pdocs()
    assert got.n_tokens.to_dict() == {i: len(model.encode(x)) for i, x in texts.items()}
    assert got.n_bytes.to_dict() == {i: len(x.encode()) for i, x in texts.items()}
    rows = token_counts.count_tokens(odd, PIECE, table_size=4).collect()
    want = collections.Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, _ in ODD)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)
    assert token_counts.count_tokens(empty, PIECE).count() == 0


# ---- near and exact duplicates


def jaccard_components(rows):
    """Brute force over all pairs of (id, text)."""
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    want = jaccard_components([(i, t) for i, t, _ in ODD if i is not None])
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_copies_of_a_large_group(spark):
    """Variants whose links form chains and islands: components equal brute force, without all pairs."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 14)), replace=False):
            words[at] = "the" if rng.random() < 0.5 else f"x{rng.integers(10_000)}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = jaccard_components(rows)
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}


def test_components_of_a_long_path_in_few_rounds(spark, monkeypatch):
    """The path 0 - n - (n-1) - ... - 1, on which labels creep by one a round; stars, cycles and pairs beside it."""
    n, rounds = 400, []
    links = [(0, n), *((i, i - 1) for i in range(n, 1, -1)), *((1000, 1000 + i) for i in range(1, 60)), *((3000 - i, 2000) for i in range(50)), (5001, 5000), (5001, 5000), (6, 6)]
    links += [(7000 + i, 7000 + (i + 1) % 9) for i in range(9)]
    kept = near_dedup.staged
    monkeypatch.setattr(near_dedup, "staged", lambda df, name: rounds.append(name) or kept(df, name))
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(60)} | {2000: 2000} | {3000 - i: 2000 for i in range(50)} | {5000: 5000, 5001: 5000} | {7000 + i: 7000 for i in range(9)}
    assert got == want and rounds.count("up") < 15
    assert near_dedup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sketch_fills_every_coordinate():
    sets = [np.arange(n, dtype=np.uint64) + np.uint64(7) for n in (1, 2, 30, 5000)]
    s = near_dedup.sketches(sets)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    x = near_dedup.sketches([near_dedup._mix(a), near_dedup._mix(b)])
    assert abs((x[0] == x[1]).mean() - 800 / 1200) < 0.15


def test_exact_dedup_of_odd_rows(odd, empty):
    got = exact_dedup.exact_dedup(odd, salts=2).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in ODD:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), math.inf if i is None else i))
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        own = by_hash[r.text_sha256]
        known = [x for x in own if x[1] != math.inf]
        assert r.group_size == len(own) and r.keep_id == (min(known)[1] if known else None)
        assert r.kept == (r.doc_id is not None and r.doc_id == r.keep_id)
    assert len(got) == len(ODD) and exact_dedup.exact_dedup(empty).count() == 0


def test_dropped_copies_are_those_of_exact_dedup(spark, odd, empty):
    rows = [(1, "abc"), (1, "xyz"), (0, "xyz"), (None, "q q"), (None, "qq"), (None, None), (7, ""), (8, " a b c"), (None, "a b c  d"), (2, "abcd")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("row", F.lit(2.0))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in exact_dedup.drop_copies(df, salts=3).collect()) == [(-1, "q q"), (0, "xyz"), (2, "abcd"), (7, ""), (8, " a b c")]
    assert exact_dedup.drop_copies(df).columns == df.columns and exact_dedup.drop_copies(empty).count() == 0
    kept = {r.doc_id for r in exact_dedup.exact_dedup(odd).where("kept").collect()}
    assert {r.doc_id for r in exact_dedup.drop_copies(odd).collect()} == kept | {None}
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("same "), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int")))).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(hot, salts=4).collect()
    assert sum(r.group_size == 1000 and r.keep_id == 9 for r in got) == 1000 and sum(r.kept for r in got) == 2001


# ---- mixing


def test_mixing_meets_targets(spark, empty):
    got = mixing.op3_mixing(spark, DATA).toPandas().set_index("doc_id")
    assert (got.rate >= 0).all() and len(got) == len(pdocs())
    for k, share in mixing.TARGETS.items():
        assert (got.rate * got.n_tokens * got[f"p_{k}"]).sum() / got.n_tokens.sum() == pytest.approx(share, abs=2e-6)
    assert np.allclose(got[["p_good", "p_plain", "p_toxic"]].sum(axis=1), 1) and got.miss.max() <= mixing.TOLERANCE
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert got.n_tokens.to_dict() == {i: len(model.encode(x)) for i, x in pdocs().items()}
    assert mixing.mix(empty, mixing.domain_labels(spark, DATA), PIECE).count() == 0


@pytest.mark.parametrize("share", [[0.6, 0.37, 0.03], [1.0, 0.0, 0.0]])
def test_rates_equal_plain_least_squares(spark, share):
    """The same squares by plain projected gradient over all rates in numpy; the last targets are out of reach."""
    rng = np.random.default_rng(8)
    p, t = rng.dirichlet([0.4, 0.3, 0.1], 300), rng.integers(0, 500, 300)
    table = spark.createDataFrame([(int(n), [float(v) for v in x]) for n, x in zip(t, p, strict=True)], "n_tokens bigint, posterior array<double>").repartition(3)
    fit = mixing.fit_rates(table, ["a", "b", "c"], dict(zip("abc", share, strict=True)))
    rate = fit.rates(p)
    w, rates = np.linalg.inv((p * t[:, None]).T @ p / t.sum()), np.ones(300)
    for _ in range(5_000):
        rates = np.maximum(0, rates - p @ (w @ (p.T @ (t * rates) / t.sum() - share)))
    miss = lambda r: p.T @ (t * r) / t.sum() - share
    assert (rate >= 0).all() and np.allclose(fit.miss, miss(rate), atol=1e-9)
    assert miss(rate) @ w @ miss(rate) <= miss(rates) @ w @ miss(rates) + 1e-6


def test_one_lookup_a_pre_token():
    """Words and tokens by code equal those by words and by the tokenizer."""
    texts = [(t or "").encode() for _, t, _ in ODD] + [x.encode() for x in pdocs()[:60]] + [b"two\nwords in\tone\n\npart \n alone", b" ", b"\n"]
    codes = mixing.Codes(PIECE)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for _ in range(2):
        flat, words, tokens = mixing.described(texts, codes)
        plain = [x for x in texts if "▁".encode() not in x]
        flat2, words2 = mixing.features(plain, mixing.WordFeatures())
        assert tokens.tolist() == [len(model.encode(x.decode())) for x in texts]
        keep = [i for i, x in enumerate(texts) if "▁".encode() not in x]
        assert words[keep].tolist() == words2.tolist()
        ends = np.cumsum(words)
        assert np.concatenate([flat[ends[i] - words[i] : ends[i]] for i in keep]).tolist() == flat2.tolist()
    assert [len(x) for x in mixing.described([], codes)] == [0, 0, 0]


def test_a_cap_keeps_rows_single(spark):
    """Targets that ask for more than there is: no rate over the cap, and no document twice."""
    rng = np.random.default_rng(9)
    p, t = rng.dirichlet([0.5, 0.5, 0.05], 400), rng.integers(1, 500, 400)
    table = spark.createDataFrame([(int(n), [float(v) for v in x]) for n, x in zip(t, p, strict=True)], "n_tokens bigint, posterior array<double>").repartition(3)
    fit = mixing.fit_rates(table, ["a", "b", "c"], lambda s: {"a": s["a"], "b": 3 * s["b"], "c": 0.0}, cap=1.0)
    rate = fit.rates(p)
    assert rate.max() <= 1 and rate[p[:, 1] > 0.98].min() == 1
    docs = documents(spark, DATA)
    once = docs.groupBy("doc_id").count().where("count > 1").count()
    got = mixing.mixed(docs, mixing.domain_labels(spark, DATA), PIECE, lambda s: {d: 2 * x for d, x in s.items()}, cap=1.0)
    assert got.groupBy("doc_id").count().where("count > 1").count() == once and got.count() == docs.count()


def test_mixing_of_odd_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 6)
    labels = spark.createDataFrame([(12, "good"), (10, "toxic"), (None, "good"), (13, None), (99, "plain"), (12, "good")], "id bigint, domain string")
    got = mixing.mix(odd, labels, PIECE).collect()
    assert len(got) == len(ODD) and all(r.rate >= 0 for r in got)
    same = mixing.mixed(odd, labels, PIECE, lambda supply: supply)
    assert same.columns == odd.columns and collections.Counter(r.doc_id for r in same.collect()) == collections.Counter(i for i, _, _ in ODD)
    twice = mixing.mixed(odd, labels, PIECE, lambda supply: {d: 2 * x for d, x in supply.items()})
    assert abs(twice.count() - 2 * len(ODD)) <= 8
    assert mixing.mixed(empty, labels, PIECE).count() == 0


# ---- shards


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(token_shards.permuted(np.arange(n), n).tolist()) == list(range(n))
    assert token_shards.permuted(np.arange(1000), 1000, 1).tolist() != token_shards.permuted(np.arange(1000), 1000, 2).tolist()


def test_shards_round_trip(odd, empty, tmp_path):
    path = str(tmp_path / "shards")
    got = token_shards.write_shards(odd, path, PIECE, length=64, shard_rows=16).toPandas().sort_values("slot")
    assert got.slot.tolist() == list(range(len(got)))
    read = list(token_shards.read_slots(path, 0, len(got), 64, 16))
    assert [zlib.crc32(a[:n].tobytes()) for a, n in zip(read, got.n_tokens, strict=True)] == got.ids_crc32.tolist()
    assert [a.tolist() for a in token_shards.read_slots(path, 20, 5, 64, 16)] == [a.tolist() for a in read[20:25]]
    order = token_shards.permuted(np.arange(len(got)), len(got))
    stream = np.concatenate([read[s][: got.n_tokens.iloc[s]] for s in order])
    texts = collections.Counter(tuple(x.tolist()) for x in np.split(stream, np.flatnonzero(stream == 2) + 1) if len(x))
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert texts == collections.Counter((*model.encode(t or ""), 2) for _, t, _ in ODD)
    assert {x for ids in got.doc_ids for x in ids} == {i for i, _, _ in ODD if i is not None}
    assert token_shards.write_shards(empty, str(tmp_path / "none"), PIECE).count() == 0


# ---- personal data


def plain_spans(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]

    def luhn(d):
        s = [int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])]
        return sum(v - 9 if v > 9 else v for v in s) % 10 == 0

    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


TRICKY = ["1.2.3.4.5.6.7.8", "01.02.03.004 256.1.1.1 1.1.1.256", "a@b.c@d.e x@y @z.w a@@b.c", "++49 123 456 789- +1(2)3", "4111-1111-1111-1111 5", "١٢٣@x.y", "a@b-.c.-d..e"]


def test_patterns_equal_plain_regexes():
    for x in [*TRICKY, *(t or "" for i, t, _ in ODD if i != 16), *pdocs()]:
        assert personal_data.pattern_spans(x) == plain_spans(x)


def test_tagger_learns_held_out_spans():
    rng = np.random.default_rng(1)
    make = lambda: "text and words before " + (f"name{rng.integers(99)}@host{rng.integers(9)}.example.com" if rng.random() < 0.5 else f"+{rng.integers(10, 99)} {rng.integers(100, 999)} {rng.integers(1000000, 9999999)}") + " and after it more"
    texts = [make() for _ in range(160)]
    tagger = personal_data.train([(t, personal_data.pattern_spans(t)) for t in texts[:120]])
    hit = 0
    for t in texts[120:]:
        starts = personal_data.windows(t)
        tags = personal_data.reconciled(len(t), starts, tagger.decode(personal_data.window_codes(t, starts)))
        hit += personal_data.spans_of(tags, t) == personal_data.pattern_spans(t)
    assert hit >= 36


def test_query_and_model_find_what_the_rules_miss(spark):
    """The query's base is that of plain regexes; held-out spans in other forms are found by the model alone."""
    folder = DATA.replace("sf0.001", "sf0.01")
    docs = documents(spark, folder)
    tagger = personal_data.learn_tagger(docs)
    texts = pd.read_parquet(f"{folder}/documents.parquet").set_index("doc_id").text.fillna("")
    got = {r.doc_id: r for r in personal_data.find_personal_data(docs, tagger).collect()}
    rng, rows = np.random.default_rng(21), []
    for i, t in texts.items():
        base = plain_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(personal_data.joined(base).encode()).hexdigest()
        assert set(personal_data.joined(base).split(",")) <= set(got[i].spans.split(","))
        if base and len(t) < 20_000:
            text, spans = personal_data.rewritten(t, base, rng)
            rows.append((i, text, spans))
    assert sum(r.spans.count(":") for r in got.values()) <= 1.05 * sum(2 * (r.n_email + r.n_ip + r.n_card + r.n_phone) for r in got.values())
    found = {r.doc_id: r for r in personal_data.find_personal_data(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), tagger).collect()}
    missed = [(i, s) for i, t, spans in rows for s in spans if s not in plain_spans(t)]
    hit = sum(personal_data.joined([s]) in found[i].spans.split(",") for i, s in missed)
    assert len(missed) > 40 and hit >= 0.7 * len(missed), (hit, len(missed))


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    tagger = personal_data.Tagger()
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    x, y = rng.integers(0, personal_data.VOCABULARY, (2, 7)), rng.integers(0, personal_data.TAGS, (2, 7))

    def loss():
        s, move = tagger.scores(x).astype(np.float64), tagger.p["move"]
        a = s[0]
        for i in range(1, len(s)):
            a = np.log(np.exp(a[:, :, None] + move[None]).sum(axis=1)) + s[i]
        gold = sum(s[i, np.arange(2), y[:, i]] for i in range(7)) + sum(move[y[:, i], y[:, i + 1]] for i in range(6))
        return float((np.log(np.exp(a).sum(axis=1)) - gold).mean())

    g = tagger._gradients(x, y)
    for k in ("out", "move", "hf", "xb", "cf", "emb"):
        at = tuple(rng.integers(0, n) for n in tagger.p[k].shape) if k != "emb" else (x[0, 3], 2)
        old = tagger.p[k][at]
        tagger.p[k][at] = old + 1e-3
        up = loss()
        tagger.p[k][at] = old - 1e-3
        down = loss()
        tagger.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_personal_data_of_odd_rows(odd, empty):
    tagger = personal_data.Tagger()
    got = personal_data.find_personal_data(odd, tagger).collect()
    texts = collections.Counter((i, hashlib.sha256(personal_data.joined(plain_spans(t or "") if i != 16 else []).encode()).hexdigest()) for i, t, _ in ODD)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == texts
    own = next(r for r in got if r.doc_id == 15)
    assert (own.n_email, own.n_ip, own.n_card, own.n_phone) == (1, 1, 1, 1) and own.spans.startswith("email:5:13,")
    assert personal_data.find_personal_data(empty, tagger).count() == 0


# ---- language model


def test_elias_fano_finds_what_is_there():
    rng = np.random.default_rng(2)
    for universe, n in ((10, 10), (5000, 3), (1 << 40, 5000), (1 << 20, 60_000)):
        values = np.unique(rng.integers(0, universe, n).astype(np.uint64))
        seq = language_model.Monotone.of(values, universe)
        assert (seq.find(values) == np.arange(len(values))).all()
        probe = rng.integers(0, universe, 2000).astype(np.uint64)
        at = np.searchsorted(values, probe)
        want = np.where((at < len(values)) & (values[np.minimum(at, len(values) - 1)] == probe), at, -1)
        assert (seq.find(probe) == want).all()


def test_elias_fano_stays_small_and_finds_in_crowds():
    rng = np.random.default_rng(3)
    universe, n = 3 << 35, 30_000
    values = np.unique(np.concatenate([rng.integers(0, universe, n), rng.integers(5 << 30, (5 << 30) + n, n), np.arange(universe - 9, universe)]).astype(np.uint64))
    seq = language_model.Monotone.of(values, universe)
    assert sum(a.nbytes for a in seq.arrays().values()) < 5.5 * len(values)
    assert (seq.find(values) == np.arange(len(values))).all()
    probe = np.concatenate([values + 1, values - 1])
    at = np.searchsorted(values, probe)
    inside = probe < universe
    want = np.where((at < len(values)) & (values[np.minimum(at, len(values) - 1)] == probe), at, -1)
    assert (seq.find(probe[inside]) == want[inside]).all()


def test_words_of_texts():
    texts = [b" a  B\x0b c\t", b"", b"\n \n", "É x\x1c\u2003y z Ab".encode(), b"a", b"q\x85w \xff Q\x0cz"]
    words, found, n = language_model.split_words(texts)
    assert [words[i] for i in found] == [w for x in texts for w in [*x.lower().split(), b"\n"]] and n.tolist() == [4, 1, 1, 5, 2, 5]


def brute_scores(train, texts):
    words = lambda x: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), x or "")), "\n"]
    c, two = collections.Counter(), collections.Counter()
    for x in train:
        w = words(x)
        c.update(w)
        two.update(zip(w, w[1:], strict=False))
    n, v, prior = sum(c.values()), len(c), language_model.PRIOR
    for x in texts:
        w = words(x)
        p = [(c[t] + 1) / (n + v + 1) for t in w]
        base = sum(math.log10(q) for q in p)
        own = math.log10(p[0]) + sum(math.log10((two[a, b] + prior * q) / (c[a] + prior)) for a, b, q in zip(w, w[1:], p[1:], strict=False))
        yield len(w), sum(c[t] > 0 for t in w), n, base, own


def test_scores(spark, odd, empty, tmp_path):
    model = language_model.fit(odd.where("doc_id > 4"), str(tmp_path / "trie"))
    got = sorted((r for r in language_model.score(odd, model).collect() if r.doc_id is not None and r.doc_id != 4), key=lambda r: r.doc_id)
    rows = [(i, t) for i, t, _ in ODD if i is not None and i != 4]
    for r, want in zip(got, brute_scores([t for i, t, _ in ODD if i is not None and i > 4], [t for _, t in sorted(rows, key=lambda x: x[0])]), strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and abs(r.score - want[4]) <= language_model.STEP * r.n_tokens
    none = language_model.fit(empty, str(tmp_path / "none"))
    assert all(r.base_score == 0 and r.n_known == 0 for r in language_model.score(odd, none).collect())
    assert language_model.score(empty, model).count() == 0


def brute_deep(train, texts, order):
    """Scores of an order-n model by its recursive definition."""
    words = lambda x: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), x or "")), "\n"]
    seen, given = collections.Counter(), collections.Counter()
    for x in train:
        w = words(x)
        for k in range(1, order + 1):
            for i in range(len(w) - k + 1):
                seen[tuple(w[i : i + k])] += 1
                given[tuple(w[i : i + k - 1])] += k > 1
    n, v, prior = sum(c for g, c in seen.items() if len(g) == 1), sum(len(g) == 1 for g in seen), language_model.PRIOR

    def p(gram):
        if len(gram) == 1:
            return (seen[gram] + 1) / (n + v + 1)
        return (seen[gram] + prior * p(gram[1:])) / (given[gram[:-1]] + prior)

    for x in texts:
        w = words(x)
        yield sum(math.log10(p(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))


@pytest.mark.parametrize("order", [3, 4])
def test_longer_contexts_count(spark, tmp_path, order):
    """A word that its last two words settle, and its last one does not."""
    train = ["a b c", "x b d"] * 400 + ["b c b d", "b", "", "q a b x b"]
    texts = ["a b c", "a b d", "x b d", "x b c", "a b new", "new b d", "b", "", "q a b x b d", "a b c a b c"]
    model = language_model.fit(spark.createDataFrame([(x,) for x in train], "text string"), str(tmp_path / "trie"), order=order)
    got = language_model.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2), model).toPandas().sort_values("doc_id")
    for own, n, want in zip(got.score, got.n_tokens, brute_deep(train, texts, order), strict=True):
        assert abs(own - want) <= language_model.STEP * n * (order - 1) / 2
    assert got.score.iloc[0] > got.score.iloc[1] + 0.5 and got.score.iloc[2] > got.score.iloc[3] + 0.5


def test_texts_are_read_once_for_words_and_once_for_all_contexts(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = spark.createDataFrame([("a b c d",), ("b c",), ("",), (None,)] * 5, "text string").mapInArrow(counted, "text string")
    model = language_model.fit(texts, str(tmp_path / "trie"), order=4)
    assert read.value == 2 * 20 and len(model.deeper) == 2 and all(model.deeper)


def test_query_uses_contexts_of_two_words(spark, tmp_path):
    got = language_model.op7_lm_scores(spark, DATA).toPandas()
    train = documents(spark, DATA).where(~language_model.held_out())
    pairs = language_model.score(documents(spark, DATA), language_model.fit(train, str(tmp_path / "two"))).toPandas()
    assert abs(got.score.sum() - pairs.score.sum()) > 1


def test_model_beats_base_on_held_out(spark):
    got = language_model.op7_lm_scores(spark, DATA).toPandas()
    own = got[got.held_out]
    assert own.score.sum() > own.base_score.sum()


# ---- packing


def check_packing(got, texts):
    tokenizer = Tokenizer.from_file(WORD)
    want = collections.Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for s, k in packing.cuts(len(ids)):
            want[(i, s, k, zlib.crc32(ids[s : s + k].tobytes()), len(ids))] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return 1 - sum(r.length for r in got) / (4096 * len(by))


def test_packing(spark, odd, empty):
    got = registry.queries()["op8_packing"](spark, DATA).collect()
    assert check_packing(got, list(pdocs().items())) < 0.03
    check_packing(packing.pack_documents(odd, WORD).collect(), [(i, t) for i, t, _ in ODD])
    assert packing.pack_documents(empty, WORD).count() == 0


def test_marks_after_letters_of_two_parts(spark):
    """Letters that become a letter and a mark take the punctuation after them into the tokenizer's own run."""
    tokenizer, table = Tokenizer.from_file(WORD), packing.WordIds(WORD)
    rng = np.random.default_rng(9)
    letters = ["İ", "KİTABİ", "SAHİBİ", "a\u0301", "ﬁ", "ß", "Σ", "ΣΑΣ", "\u212b", "\u0958", "क़", "\ufb1d", "日本", "x", "Ab", "é", "ǅ", "\u1e9e", "ｆ", "१", "\u2126"]
    marks = [bytes([c]).decode() for c in packing._MARKS] + ["...", "?!", ".,;", "'s", "", "", "<|endoftext|>", "\u0307.", "।", "。"]
    words = [letters[a] + letters[b] * int(k) + marks[m] for a, b, k, m in zip(rng.integers(0, len(letters), 12_000), rng.integers(0, len(letters), 12_000), rng.integers(0, 2, 12_000), rng.integers(0, len(marks), 12_000), strict=True)]
    words += [x + m for x in letters for m in marks]
    texts = [" ".join(words[i : i + 1 + i % 5]) for i in range(len(words))]
    for text, ids in zip(texts, packing.encoded([x.encode() for x in texts], table, b""), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_tiny_pieces_fill_windows():
    sizes = np.ones(200_000, dtype=np.int64)
    sets = packing.fill(sizes)
    assert len(sets) == math.ceil(200_000 / 4096) and sorted(np.concatenate(sets).tolist()) == list(range(200_000))
    mixed = np.random.default_rng(4).integers(1, 90, 40_000)
    sets = packing.fill(mixed)
    assert max(int(mixed[x].sum()) for x in sets) <= 4096 and len(sets) <= math.ceil(mixed.sum() / 4096) + 1 and sum(map(len, sets)) == 40_000


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(0).integers(1, 1025, 600)
    sets = packing.difference(sizes, 80)
    sums = [int(sizes[x].sum()) for x in sets]
    assert sorted(i for x in sets for i in x) == list(range(600)) and max(sums) - min(sums) <= 40
    assert len(packing.fill(np.array([3000, 3000, 3000]))) == 3 and packing.fill(np.zeros(0, dtype=np.int64)) == []


# ---- languages


def test_languages_on_held_out(spark):
    got = language_id.op9_language_id(spark, DATA).toPandas().merge(pd.read_parquet(f"{DATA}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    own = got[got.held_out]
    assert (own.lang == own.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    assert set(got.held_out) == {True, False} and all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_languages_of_odd_rows(odd, empty):
    profiles = language_id.learn(odd)
    got = {r.doc_id: r for r in language_id.identify(odd, profiles).collect()}
    assert len(profiles.names) == 2 and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 8))
    assert got[18].lang_pred == "en" and got[19].lang_pred == "fr"
    assert language_id.identify(odd, language_id.learn(empty)).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty, profiles).count() == 0
    kept = language_id.reject_unidentified(odd, profiles)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 4
    assert language_id.reject_unidentified(odd, language_id.learn(empty)).count() == len(ODD) - 4


def test_predictions_equal_plain_out_of_place_sums():
    def plain_list(text):
        runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        padded = " " + " ".join(runs) + " "
        counts = collections.Counter(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]).strip())
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], sum(ord(c) << 21 * i for i, c in enumerate(x[0]))))][:40]

    texts = pdocs().tolist()[:60]
    lists = {f"l{i}": language_id.ranked(*language_id.grams(x), 40) for i, x in enumerate(texts[:12])}
    profiles, plain = language_id.Profiles(lists, 40), {f"l{i}": plain_list(x) for i, x in enumerate(texts[:12])}
    for text in texts[12:]:
        own = plain_list(text)
        far = {k: sum(abs(v.index(g) - i) if g in v else 40 for i, g in enumerate(own)) for k, v in plain.items()}
        best = min(sorted(far), key=far.get)
        assert profiles.predict(text) == (best, pytest.approx(1 - far[best] / (40 * len(own))))


def test_all_labels_are_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"lang{i}") for i in range(300)]
    assert len(language_id.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).names) == 300


def test_out_of_place_distance_by_hand():
    lists = {"x": np.array([1, 2, 3]), "y": np.array([3, 2, 9])}
    p = language_id.Profiles(lists, 3)
    assert p.place[0].tolist()[:4] == [0, 1, 2, -1] and p.place[1].tolist()[:4] == [-1, 1, 0, 2]


# ---- vectors


def recall(got, ids, x, queries, k=20):
    hit = total = 0
    for q in queries:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        top = ids[np.lexsort((ids, -s))[:k]]
        own = got[got.query_id == q].sort_values("rank")
        hit += len(set(top) & set(own.vec_id))
        total += len(top)
        assert own["rank"].tolist() == list(range(1, len(top) + 1)) and (np.diff(own.score) <= 0).all()
    return hit / total


def test_nearest(spark):
    got = vector_search.op10_nearest(spark, DATA).toPandas()
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    ids = e.vec_id.to_numpy()
    assert set(got.query_id) == set(ids[ids % 20 == 0])
    assert recall(got, ids, np.array(e.embedding.tolist(), dtype=np.float64), ids[ids % 20 == 0]) >= 0.97


def test_nearest_over_several_blocks(spark):
    """Clusters, copies and norms of all sizes, in some ten blocks; the same number is reranked as in a small table."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = (centres[rng.integers(0, 60, 40_000)] + 0.6 * rng.normal(size=(40_000, 32))) * rng.uniform(0.3, 1.5, (40_000, 1))
    x[5000:5300] = x[77]
    x = x.astype(np.float32)
    ids = rng.permutation(100_000)[:40_000]
    table = pa.table({"vec_id": ids, "embedding": pa.ListArray.from_arrays(np.arange(0, x.size + 1, 32, dtype=np.int32), x.ravel())})
    df = spark.createDataFrame(table).repartition(4)
    got = vector_search.nearest(df, df.where("vec_id % 400 = 0")).toPandas()
    assert recall(got, ids, x.astype(np.float64), ids[ids % 400 == 0]) >= 0.9


def test_table_scan_equals_decoded_products():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 7))
    book = vector_search.Codebook(7).fit(x)
    code, ids, q = book.code(x), np.arange(500) * 3, rng.normal(size=(9, 7))
    four = np.stack((code & 15, code >> 4), axis=2).reshape(500, -1)[:, :7]
    decoded = np.stack([book.centres[d][four[:, d], 0] for d in range(7)], axis=1)
    at, i, s = vector_search.scan(book, [(ids[:300], code[:300]), (ids[300:], code[300:])], np.array([0, 3, 6, 1, 1, 1, 1, 1, 1]), q, 10)
    for n in range(9):
        plain = decoded @ q[n]
        plain[ids == [0, 3, 6, 1, 1, 1, 1, 1, 1][n]] = -np.inf
        assert sorted(i[at == n]) == sorted(ids[np.argsort(-plain)[:10]]) and np.allclose(sorted(s[at == n]), np.sort(plain)[-10:], atol=1e-4)


@pytest.mark.parametrize("kind", ["tight", "lengths", "sparse", "heavy"])
def test_nearest_misses_none(spark, kind):
    """Rows that four bits a dimension cannot tell apart: clusters of small spread, lengths, zeros and tails of all sizes; with copies."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9000, 32))
    if kind == "tight":
        x = rng.normal(size=(20, 32))[rng.integers(0, 20, 9000)] + 0.003 * x
    elif kind == "lengths":
        x *= np.exp(2 * rng.normal(size=(9000, 1)))
    elif kind == "sparse":
        x = x * (rng.random((9000, 32)) < 0.06) + 1e-3
    else:
        x = rng.standard_t(1.2, size=(9000, 32))
    x[100:160] = x[7]
    x = x.astype(np.float32)
    ids = rng.permutation(9000)
    df = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.ListArray.from_arrays(np.arange(0, x.size + 1, 32, dtype=np.int32), x.ravel())})).repartition(3)
    got = vector_search.nearest(df, df.where("vec_id % 100 = 0")).toPandas()
    wide = x.astype(np.float64)
    for query, own in got.sort_values("rank").groupby("query_id"):
        score = np.einsum("ij,j->i", wide, wide[ids == query][0])
        score[ids == query] = -np.inf
        top = np.lexsort((ids, -score))[:20]
        assert np.allclose(own.score, score[top], rtol=1e-12) and len(set(own.vec_id) - set(ids[score >= score[top[-1]] * (1 - 1e-12)])) == 0
    assert got.query_id.nunique() == 90


def test_nearest_of_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0, 2.0]), (20, [0.0, 1.0, 1.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 0.0]), (4, [1.0, nan, 0.0]), (5, [1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (7, [3.0, 0.0, 0.0]), (60, [1.0, 2.0]), (9, [0.0, 1.0]), (8, [3.0, 0.0, 0.0]), (8, [3.0, 0.0, 0.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit(1)).withColumn("rank", F.lit("x"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.nearest(df, df.where("vec_id % 20 = 0")).collect()]
    assert sorted(got) == [(0, 1, 7, 3.0), (0, 2, 8, 3.0), (0, 3, 8, 3.0), (0, 4, 20, 2.0), (20, 1, 0, 2.0), (20, 2, 7, 0.0), (20, 3, 8, 0.0), (20, 4, 8, 0.0), (60, 1, 5, 3.0), (60, 2, 9, 2.0)]
    assert vector_search.nearest(df.where("false"), df).count() == 0
    assert vector_search.nearest(df.where("vec_id in (1, 2, 3)"), df).count() == 0


# ---- pipeline


def test_pipeline(spark, oracle):
    import corpus_pipeline as cp

    docs = documents(spark, DATA)
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).toPandas(), docs.schema)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    texts = pdocs()
    kept = {re.sub("[\x20\x09-\x0d]", "", x) for x in texts if any(c.isalpha() for c in x)}
    assert sizes[2] == len(kept) and sizes[3] <= sizes[2]
    labels = pd.read_parquet(f"{DATA}/labels.parquet").set_index("doc_id").toxic
    after = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert sum(after[i] for i in labels[labels == 0].index if i in after) >= 0.98 * sum(i in after for i in labels[labels == 0].index)
    packed = cp.pack(spark, docs, DATA).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert cp.run(spark, DATA).count() == len(packed)


def test_pipeline_of_odd_and_empty_rows(spark, odd, empty):
    import corpus_pipeline as cp

    for docs, least in ((odd, 9), (empty, 0)):
        for name, stage in cp.STAGES[:-1]:
            columns = docs.columns
            docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
            assert docs.columns == columns, name
        texts = [r.text for r in docs.select("text").collect()]
        assert len(texts) >= least and len(texts) == len(set(texts)) and all(any(c.isalpha() for c in x) for x in texts)
        if least:
            assert "a row without id" in texts and LONG in texts
        assert cp.pack(spark, docs, DATA).count() >= len(texts)
