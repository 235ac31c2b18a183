"""Operators that read texts, against brute force over whole tables and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import queries as q
from tesserae.llm import chaining, decontamination, encoding, ngram_join
from tesserae.llm.chaining import chains, fuzzy_passages
from tesserae.llm.common import SLICE_ROWS, kth_largest, sliced, table
from tesserae.llm.decontamination import decontaminate, keep_clean
from tesserae.llm.importance import BUCKETS, ngram_buckets, resample
from tesserae.llm.ngram_join import choose_bands, keep_one_per_class, ngram_jaccard_join
from tesserae.llm.quality_rules import RuleList, apply_rules, judge, learn_rules, text_statistics
from tesserae.llm.token_blocks import token_table
from tesserae.llm.token_counts import CACHE_SCHEMA, count_tokens
from tesserae.llm.toxicity import IDENTITY_TERMS, WORD, ToxicityModel, counterfactuals, drop_toxic, fit, held_out, score

#: Null, empty, blank, long, repeated rows, a null id, and columns whose names the operators use themselves.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "word " * 30_000), (6, "a b c d e f g h i j k l m n"), (7, "a b c d e f g h i j k l m n"),
    (7, "a b c d e f g h i j k l m n"), (None, "a b c d e f g h i j k l m n"), (8, "café 中文 \U0001f600 <|endoftext|> x"), (9, "Nice day now"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({"words": F.lit("clash"), "rep": F.lit(1), "n": F.lit(0), "digest": F.lit("x"), "source": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_kth_largest_counts_ties(spark):
    values = [-(2**63), -5, -5, 0, 7, 7, 7, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values, reverse=True)
    for k in range(1, len(values) + 1):
        v = ordered[k - 1]
        assert kth_largest(df, "v", k) == (v, k - sum(x > v for x in values))
    assert kth_largest(df, "v", 0) is None and kth_largest(df, "v", 99) is None


# Importance resampling


def test_resampling_takes_the_largest_keys(spark, sf_dir, docs):
    got = rows_of(q.op1_importance_resampling(spark, sf_dir))
    assert len(got) == docs.count() and sum(r["selected"] for r in got) == round(0.85 * len(got))
    assert min(r["sample_key"] for r in got if r["selected"]) >= max(r["sample_key"] for r in got if not r["selected"]) - 1e-5


def test_resampling_weights_equal_a_brute_force(spark, sf_dir, texts):
    target = {r["doc_id"] for r in table(spark, sf_dir, "labels").where("quality = 1").collect()} & texts.keys()
    raw, like = Counter(), Counter()
    for k, t in texts.items():
        own = Counter(ngram_buckets(t).tolist())
        raw += own
        if k in target:
            like += own
    share = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + BUCKETS))
    ratio = [share(like, b) - share(raw, b) for b in range(BUCKETS)]
    rows = rows_of(q.op1_importance_resampling(spark, sf_dir))
    for r in rows:
        assert r["log_weight"] == pytest.approx(sum(ratio[b] for b in ngram_buckets(texts[r["doc_id"]])), abs=1e-6)
    best = sorted(rows, key=lambda r: -r["sample_key"])[: round(0.85 * len(rows))]
    assert {r["doc_id"] for r in best} == {r["doc_id"] for r in rows if r["selected"]}


def test_resampling_draws_the_target_rows(spark, docs):
    weights = lambda n: {r["doc_id"]: r["log_weight"] for r in rows_of(resample(docs, docs.select("doc_id"), 0.5, target_rows=n))}
    assert max(map(abs, weights(50_000).values())) < 1e-6 < max(map(abs, weights(20).values()))


def test_resampling_splits_ties_by_a_hash(spark):
    docs = spark.createDataFrame([(7, "same text")] * 6 + [(8, "same text")], "doc_id long, text string")
    got = rows_of(resample(docs, docs.select("doc_id"), share=0.5))
    assert len({r["selected"] for r in got if r["doc_id"] == 7}) == 1 and any(r["selected"] for r in got)


def test_resampling_prefers_what_is_like_the_target(spark):
    rows = [(k, "alpha beta gamma " * 5 if k % 2 else "delta epsilon zeta " * 5) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(resample(docs, docs.where("doc_id % 2 = 1 AND doc_id < 100").select("doc_id"), share=0.5))
    assert sum(r["selected"] for r in got) == 100 and sum(r["selected"] and r["doc_id"] % 2 for r in got) > 90


def test_resampling_of_odd_rows(spark, odd, none):
    got = rows_of(resample(odd, odd.where("doc_id = 4").select("doc_id"), share=0.5))
    assert len(got) == len(ODD) and all(r["log_weight"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert resample(none, none.select("doc_id"), 0.5).count() == 0


# Toxicity


def test_toxicity_on_rows_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows_of(q.op4_counterfactual_toxicity(spark, sf))}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in table(spark, sf, "labels").collect() if got[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.9


def test_held_out_labels_change_nothing(spark, sf_dir, docs):
    labels = table(spark, sf_dir, "labels")
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert fit(docs, labels) == fit(docs, flipped)


def test_a_group_name_alone_does_not_make_a_text_toxic(spark):
    bad = [(k, f"you muslim scum number {'abcdefghij'[k % 10]} go away vile") for k in range(0, 120, 2)]
    good = [(k, f"my friend number {'abcdefghij'[k % 10]} cooks fine dinners") for k in range(1, 120, 2)]
    docs = spark.createDataFrame(bad + good, "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).alias("toxic"))
    test = spark.createDataFrame([(1000, "the muslim family cooks dinners"), (1001, "vile scum go away")], "doc_id long, text string")
    with_penalty = {r["doc_id"]: r["score"] for r in score(test, fit(docs, labels, penalty=10.0)).collect()}
    without = {r["doc_id"]: r["score"] for r in score(test, fit(docs, labels, penalty=0.0)).collect()}
    assert with_penalty[1000] < 0.5 < with_penalty[1001] and with_penalty[1000] < without[1000]


def test_counterfactuals_swap_inside_the_class_only():
    pairs = counterfactuals("A woman spoke. Nothing else!", {"g": ("person", "woman", "man")})
    assert pairs >= {("a woman spoke", "a man spoke"), ("a woman spoke", "a person spoke")}
    drawn = pairs - {("a woman spoke", "a man spoke"), ("a woman spoke", "a person spoke")}
    assert len(drawn) == 2 and len({a for a, _ in drawn}) == 1  # a term put in at a drawn place, and swapped
    assert counterfactuals("", {"g": ("person", "woman")}) == {("woman", "person")} and counterfactuals("a woman", {"g": ("person",)}) == set()


def test_naming_a_group_does_not_make_clean_held_out_texts_toxic(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    clean = [r["text"] for r in docs.join(labels.where("toxic = 0"), "doc_id").where(held_out(F.col("doc_id"))).select("text").collect() if r["text"]][:80]
    terms = sorted({t for group in IDENTITY_TERMS.values() for t in group[1:]})
    assert not any(t in WORD.findall(c.lower()) for c in clean for t in terms[:3]) and len(clean) > 50

    def false_positives(model):
        of = model.scorer()
        plain = of(clean)
        named = np.array([of([f"{t} {c}" for c in clean]) for t in terms])
        return (plain >= 0.3).mean(), (named >= 0.3).mean(), np.abs(named - plain).max()

    # The registered query's own model; then labels that blame one group, with and without the penalty.
    plain, named, moved = false_positives(fit(docs, labels))
    assert named <= plain + 0.01 and moved < 0.2
    blamed = docs.join(labels.where("toxic IN (0, 1)"), "doc_id").select("doc_id", F.when(F.col("toxic") == 1, F.concat(F.lit("muslim "), "text")).otherwise(F.col("text")).alias("text"))

    def moved_by_name(penalty):
        of = fit(blamed, labels, penalty=penalty).scorer()
        logit = lambda texts: np.log(of(texts) / (1 - of(texts)))
        return np.abs(logit([f"muslim {c}" for c in clean]) - logit([f"person {c}" for c in clean])).mean()

    assert moved_by_name(10.0) < 0.5 * moved_by_name(0.0)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    model = fit(odd, labels)
    got = rows_of(score(odd, model))
    assert len(got) == len(ODD) and len({r["score"] for r in got}) == 1
    assert fit(none, labels).features == () and score(none, model).count() == 0
    strict = ToxicityModel((), (), 5.0)
    assert drop_toxic(odd, strict).count() == 0 and drop_toxic(odd, ToxicityModel((), (), -5.0)).columns == odd.columns


# Token counts and token blocks


def test_token_counts_are_the_librarys(spark, sf_dir, texts, odd):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    for r in rows_of(q.op5_digest_cache_token_counts(spark, sf_dir)):
        t = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), count(t), count(t) > 2048)
    got = Counter((r["doc_id"], r["n_tokens"]) for r in rows_of(count_tokens(odd)))
    assert got == Counter((k, count(t)) for k, t in ODD)


def test_cached_counts_are_not_made_again(spark, odd, none, tmp_path):
    at = str(tmp_path / "cache")
    first = sorted(map(str, count_tokens(odd, cache=at).collect()))
    size = spark.read.schema(CACHE_SCHEMA).parquet(at).count()
    assert size == len({" ".join((t or "").split(" ")) for _, t in ODD if (t or "").strip()}) + 1  # null, empty and blank are one
    assert sorted(map(str, count_tokens(odd, cache=at).collect())) == first
    assert spark.read.schema(CACHE_SCHEMA).parquet(at).count() == size
    assert count_tokens(none, cache=at).count() == 0


def test_the_count_query_meets_a_half_filled_cache(spark, sf_dir, docs, monkeypatch):
    from tesserae.llm import token_counts

    encoded = []
    monkeypatch.setattr(token_counts, "_counter", lambda path, f=token_counts._counter: encoded.append(path) or f(path))
    paths = []
    monkeypatch.setattr(q, "fresh_path", lambda s, name, f=q.fresh_path: paths.append(f(s, name)) or paths[-1])
    got = {r["doc_id"]: r["n_tokens"] for r in rows_of(q.op5_digest_cache_token_counts(spark, sf_dir))}
    assert got == {r["doc_id"]: r["n_tokens"] for r in rows_of(count_tokens(docs))}
    stored = spark.read.schema(CACHE_SCHEMA).parquet(paths[0])
    assert len(encoded) == 3 and stored.count() == stored.select("digest").distinct().count() == rows_of(count_tokens(docs).select(F.countDistinct("digest").alias("n")))[0]["n"]


def test_a_half_filled_cache_is_met(spark, sf_dir, docs, tmp_path):
    at, half = str(tmp_path / "cache"), docs.where("doc_id % 2 = 0")
    count_tokens(half, cache=at)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(at)
    marked = stored.withColumn("tokens", F.col("tokens") + 1_000_000)  # so that what is met shows
    marked.write.parquet(str(tmp_path / "marked"))
    got = {r["doc_id"]: r["n_tokens"] for r in rows_of(count_tokens(docs, cache=str(tmp_path / "marked")))}
    plain = {r["doc_id"]: r["n_tokens"] for r in rows_of(count_tokens(docs))}
    met = {r["digest"] for r in stored.collect()}
    for r in rows_of(count_tokens(docs, cache=at)):
        assert got[r["doc_id"]] == plain[r["doc_id"]] + (1_000_000 if r["digest"] in met else 0) and r["n_tokens"] == plain[r["doc_id"]]
    again = spark.read.schema(CACHE_SCHEMA).parquet(at)
    assert again.count() == again.select("digest").distinct().count() > stored.count()


@pytest.mark.parametrize("plain", [False, True])
def test_marks_and_new_lines_behind_words_need_no_pre_tokenizer(plain):
    enc = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"), plain)
    rows = ["a den$$$ ef,***\nGh&&& \u00e9t\u00e9.\n\u00c9t\u00e9, x'.\nY_ Ab!", "a x\u00b2 \u216b\nab it's x'\nS's a1. b\n\nc d\n e <|endoftext|> f<|endoftext|>\ng", "a \u01c5b. \u02b0x\nI b__\n_ \u00bd!"]
    for text in rows:
        assert enc.ids(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    met, piece = [], enc._piece
    enc._piece = lambda p: met.append(p) or piece(p)
    enc.cache.clear()
    enc.ids(rows[0])
    assert met == ["a"]  # the head of a text


def test_token_blocks_hold_the_librarys_ids(spark, sf_dir, texts, odd, none):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def crc(t):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        return len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))

    start = 0
    for r in sorted(rows_of(q.op2_patched_frame_of_reference(spark, sf_dir)), key=lambda r: r["doc_id"]):
        n, digest = crc(texts[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, n, digest)
        start += n
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(token_table(odd, segment_ids=50)))
    assert got == Counter((k, *crc(t)) for k, t in ODD)
    assert token_table(none).count() == 0


# Fuzzy passages


def test_chains_score_like_a_quadratic_search():
    matches = [(0, 5), (3, 8), (9, 14), (9, 2), (20, 26), (21, 3), (100, 300), (104, 304)]

    def best(k=8, cost=0.2):
        score = {}
        for q_, t in sorted(matches):
            before = [score[a, b] - cost * (q_ - a + t - b) for a, b in score if a < q_ and b < t]
            score[q_, t] = k + max(0.0, *before, 0.0)
        return max(score.values())

    made = chains(matches)
    total = lambda c: 8 * len(c) - 0.2 * (c[-1][0] - c[0][0] + c[-1][1] - c[0][1])
    assert max(map(total, made)) == pytest.approx(best())
    assert all(a < c and b < d for chain in made for (a, b), (c, d) in zip(chain, chain[1:]))


def test_fuzzy_passages_are_found(spark, odd, none):
    word = lambda k: hashlib.md5(str(k).encode()).hexdigest()[:7]
    passage = [word(k) for k in range(80)]
    fuzzy = [w if k % 25 else "changed" for k, w in enumerate(passage)]
    own = lambda n, at: [word(10_000 * n + k) for k in range(at)]
    rows = [(1, own(1, 40) + passage + own(2, 30)), (2, own(3, 10) + fuzzy), (3, own(4, 90)), (4, passage[:30] + own(5, 60)), (5, own(6, 5) + passage + own(7, 3))]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(fuzzy_passages(docs))}
    assert set(got) == {2, 5} and all(r["source_id"] == 1 and r["identity"] >= 0.8 for r in got.values())
    assert got[5]["start_word"] <= 6 and got[5]["end_word"] >= 84 and got[2]["n_matched"] >= 72
    assert fuzzy_passages(none).count() == 0 and fuzzy_passages(odd).columns[0] == "doc_id" and fuzzy_passages(odd).count() == 0


def edited(passage, identity, rng, word):
    out = list(passage)
    for k in rng.sample(range(len(out)), round(len(out) * (1 - identity))):
        out[k] = word()
    return out


def test_fuzzy_passages_of_the_least_identity_are_found(spark):
    rng = random.Random(50)
    word = lambda: f"w{rng.getrandbits(40):x}"
    own = lambda: [word() for _ in range(40)]
    cases, rows = [(50, 0.8), (60, 0.8), (60, 0.85), (60, 0.9), (100, 0.8)], []
    for c, (n, identity) in enumerate(cases):
        for k in range(1000 * c, 1000 * c + 100):
            passage = [word() for _ in range(n)]
            rows += [(2 * k, own() + passage + own()), (2 * k + 1, own() + edited(passage, identity, rng, word) + own())]
    spread = [word() for _ in range(60)]
    rows += [(20_000, own() + spread), (20_001, own() + [word() if k % 7 == 3 else w for k, w in enumerate(spread)])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(fuzzy_passages(docs))}
    found = [sum(2 * k + 1 in got for k in range(1000 * c, 1000 * c + 100)) for c in range(len(cases))]
    print(dict(zip(cases, found)))
    assert all(r["source_id"] == k - 1 and r["identity"] >= 0.8 for k, r in got.items())
    assert min(found) >= 97 and 20_001 in got


@pytest.mark.parametrize("table_bits", [1 << 27, 64])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, table_bits):
    monkeypatch.setattr(chaining, "TABLE_BITS", table_bits)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for seed in range(150):
        rng = random.Random(seed)
        a, b = ([rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randrange(40))] for _ in "ab")
        runs = chaining.common_runs(a, b)
        assert len(runs) == longest(a, b) and all(a[i] == b[j] for i, j in runs)
        assert all(p[0] < r[0] and p[1] < r[1] for p, r in zip(runs, runs[1:]))


def test_gaps_of_any_length_are_aligned(spark):
    # One word put in, every seventh word of the gap changed: as many words match whatever the gap's length.
    rows, gaps = [], (300, 390, 400, 500, 1500)
    for gap in gaps:
        lead, middle, tail = own(f"lead {gap}", 1500), own(f"middle {gap}", gap), own(f"tail {gap}", 1500)
        changed = ["put-in", *(f"x{k}" if k % 7 == 0 else w for k, w in enumerate(middle))]
        rows += [(2 * gap, lead + middle + tail), (2 * gap + 1, lead + changed + tail)]
    got = rows_of(fuzzy_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")))
    want = [(2 * gap + 1, 2 * gap, 0, 3001 + gap, 3000 + gap - -(-gap // 7)) for gap in gaps]
    assert sorted((r["doc_id"], r["source_id"], r["start_word"], r["end_word"], r["n_matched"]) for r in got) == want


def test_texts_of_one_id_are_apart(spark):
    passage = own("shared", 60)
    rows = [(1, own("a") + passage), (2, own("b", 10) + passage), (2, own("c", 120) + passage), (2, own("c", 120) + passage), (1, passage + own("d"))]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = rows_of(fuzzy_passages(docs))
    assert Counter((r["doc_id"], r["start_word"], r["end_word"], r["source_id"]) for r in got) == Counter([(2, 10, 70, 1), (2, 120, 180, 1)])
    assert len({r["part"] for r in got}) == 2


def aligned_passages(texts, size=50, least=0.8):
    """Ids of documents with a window of `size` words that matches an earlier document that well: every pair, by alignment."""
    words = {k: (t or "").lower().split() for k, t in texts.items()}
    found = set()
    for b in sorted(words):
        mine = set(words[b])
        for a in sorted(words):
            if a >= b:
                break
            if len(mine & set(words[a])) < least * size * 0.5:
                continue
            hit = np.zeros(len(words[b]) + 1, int)
            for i, _ in chaining.common_runs(words[b], words[a]):
                hit[i + 1] = 1
            total = np.cumsum(hit)
            if len(total) > size and (total[size:] - total[:-size]).max() >= least * size:
                found.add(b)
                break
    return found


def test_the_query_finds_what_all_pairs_do(spark, sf_dir, texts):
    # Exact repeats of 50 words, by brute force: none may be missed. The query may find more, since it allows edits.
    seen, repeats = {}, set()
    for k in sorted(texts):
        w = (texts[k] or "").lower().split()
        for i in range(len(w) - 49):
            first = seen.setdefault(tuple(w[i : i + 50]), k)
            if first != k:
                repeats.add(k)
    rows = rows_of(q.op6_collinear_chaining(spark, sf_dir))
    got = {r["doc_id"] for r in rows}
    assert repeats and repeats <= got
    # What it reports beyond them holds against the two texts themselves.
    for r in rows:
        a, b = (texts[r[c]].lower().split()[r[x] : r[y]] for c, x, y in (("doc_id", "start_word", "end_word"), ("source_id", "source_start", "source_end")))
        assert len(chaining.common_runs(a, b)) >= r["n_matched"] >= 0.8 * max(len(a), len(b)) and min(len(a), len(b)) >= 40
    # Fuzzy ones by aligning all pairs of a sample of short texts: those found are nearly all.
    some = {k: t for k, t in texts.items() if len((t or "").split()) <= 400}
    want = aligned_passages(some)
    assert len(want & got) >= 0.9 * len(want)


def own(n, size=60):
    return [hashlib.md5(f"{n} {k}".encode()).hexdigest()[:7] for k in range(size)]


def test_a_passage_is_found_where_earlier_documents_hold_its_parts(spark):
    passage = own("p", 56)
    rows = [(1, own(1) + passage[:30] + own(2)), (2, own(3) + passage[26:] + own(4)), (3, own(5) + passage + own(6)), (4, own(7) + passage + own(8))]
    got = rows_of(fuzzy_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")))
    assert [(r["doc_id"], r["source_id"], r["start_word"], r["end_word"]) for r in got] == [(4, 3, 60, 116)]


def test_an_edited_passage_is_found_where_earlier_documents_hold_its_parts(spark):
    rng, rows, want, new = random.Random(3), [], {}, iter(range(10**7))
    words = lambda n, c="w": [f"{c}{next(new)}" for _ in range(n)]
    shapes = ((0.95, 56), (0.9, 56), (0.9, 80), (0.85, 80))
    for identity, size in shapes:
        for _ in range(25):
            base = words(size)
            edited = list(base)
            for x in rng.sample(range(size), round(size * (1 - identity))):
                edited[x] = f"e{next(new)}"
            parts = base[: size // 2 + 2], base[size // 2 - 2 :], base, edited  # the halves overlap by four words
            at = len(rows)
            rows += [(at + k, " ".join([*words(30), *p, *words(30)])) for k, p in enumerate(parts)]
            want[at + 3] = identity, size, at + 2
    found = {(r["doc_id"], r["source_id"]) for r in rows_of(fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")))}
    hits = Counter((i, n) for d, (i, n, c) in want.items() if (d, c) in found)
    assert all(hits[s] >= 23 for s in shapes), hits


def test_a_bitmap_of_any_size_loses_no_passage(spark, texts, docs, monkeypatch):
    whole = sorted(map(str, fuzzy_passages(docs).collect()))
    monkeypatch.setattr(chaining, "MAP_BITS", 1 << 15)
    assert sorted(map(str, fuzzy_passages(docs).collect())) == whole and whole


def test_a_passage_is_found_where_its_lines_recur_in_another_order(spark):
    lines = [own(f"line {k}", 20) for k in range(3)]
    source = [*own(9), *lines[2], *own(10), *lines[1], *own(11), *lines[0], *own(12), *lines[0], *lines[1], *lines[2], *own(13)]
    rows = [(5, source), (6, own(14) + lines[0] + lines[1] + lines[2] + own(15))]
    got = rows_of(fuzzy_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")))
    assert [(r["doc_id"], r["source_id"], r["start_word"], r["end_word"], r["source_start"]) for r in got] == [(6, 5, 60, 120, 300)]


# Quality rules


def stats_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    where = defaultdict(list)
    for k in range(len(words) - 7):
        where[tuple(words[k : k + 8])].append(k)
    covered = {p + j for at in where.values() if len(at) > 1 for p in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_verdicts(spark, sf_dir, texts):
    got = rows_of(q.op8_decision_list_quality(spark, sf_dir))
    assert len(got) == len(texts)
    for r in got:
        own = stats_of(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == own
        assert r["base_failed"] == (own[0] < 20 or 100 * own[4] > 30 * own[0])
        assert r["kept"] == (not r["base_failed"] and r["rule"] == 0)


def test_quality_rules_agree_with_labels_they_did_not_prune_on(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows_of(q.op8_decision_list_quality(spark, sf))}
    labels = rows_of(table(spark, sf, "labels"))
    good, bad = ([got[r["doc_id"]] for r in labels if r["quality"] == k] for k in (1, 0))
    assert sum(r["kept"] for r in good) / len(good) > 0.9
    # The list itself rejects bad texts that the base rule lets pass, and few good ones: an empty list fails here.
    by_rule = [sum(r["rule"] > 0 for r in rows) for rows in (good, bad)]
    assert by_rule[1] >= 10 and by_rule[1] / sum(by_rule) > 0.9
    assert sum(r["rule"] > 0 and not r["base_failed"] for r in bad) > 0


def test_covering_finds_planted_rules(spark):
    rng = random.Random(2)
    rows = []
    for k in range(3000):
        kind = k % 6
        symbols, dup, words = rng.randrange(5), rng.randrange(3), 100
        if kind == 0:
            symbols = 40 + rng.randrange(20)
        if kind == 1:
            dup = 30 + rng.randrange(20)
        rows.append((k, words, 500, symbols, dup, 0, 10, 5, 40, 80, int(kind > 1)))
    names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_digits, n_lines, n_distinct_words, quality"
    stats = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split(", ")))
    rules = learn_rules(stats, "quality", "doc_id")
    assert {c.feature for conds, _ in rules.rules for c in conds} == {"symbols_per_word", "dup_lines_per_100_words"} and len(rules.rules) == 2
    got = judge(stats, rules)
    assert got.where("(rule > 0) <> (quality = 0)").count() == 0
    # The same by hand: the best single cut of the first rule, over all cuts of all features.
    assert all(p == 1.0 for _, p in rules.rules) and all(len(conds) == 1 and conds[0].above for conds, _ in rules.rules)
    assert learn_rules(stats.where("quality = 1"), "quality", "doc_id").rules == ()


def test_quality_of_odd_rows(spark, odd, none):
    got = Counter((r["doc_id"], r["n_words"], r["n_repeat_words"], r["kept"]) for r in rows_of(apply_rules(odd, RuleList(()))))
    assert got == Counter((k, stats_of(t)[0], stats_of(t)[4], False) for k, t in ODD)
    assert text_statistics(none).count() == 0


# N-gram Jaccard join


def ngrams(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def classes_of(texts: dict):
    """(class, links) of every document by comparing all pairs."""
    sets, root = {k: ngrams(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links, keys = Counter(), sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (find(k), links[k]) for k in texts}


def test_jaccard_join_equals_all_pairs(spark, sf_dir, texts, docs):
    joined = q.op9_minhash_ngram_jaccard(spark, sf_dir)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows_of(joined)}
    want = classes_of(texts)
    assert got == want and any(n for _, n in want.values())
    kept = keep_one_per_class(docs, ngram_jaccard_join(docs))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for c, _ in want.values()}


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:-1], f"end{k}"])) for k in range(700)] + [(1000 + k, " ".join(base)) for k in range(50)]
    got = rows_of(ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r["class_id"] for r in got} == {0} and {r["n_links"] for r in got} == {749}


def test_jaccard_join_of_large_groups_equals_all_pairs(spark, monkeypatch):
    # Blocks and cores of a few members each: near copies at several distances, in and out of the core.
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 8)
    monkeypatch.setattr(ngram_join, "CORE_MEMBERS", 4)
    monkeypatch.setattr(ngram_join, "PIVOT_MEMBERS", 16)
    rng, base = random.Random(4), [f"w{k}" for k in range(400)]
    rows = {}
    for k in range(150):
        w = list(base)
        for _ in range(k % 14):
            w[rng.randrange(400)] = f"x{rng.random()}"
        rows[k] = " ".join(w)
    rows |= {1000 + k: " ".join([*base[:60], f"end{k}"]) for k in range(30)}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows_of(ngram_jaccard_join(spark.createDataFrame(list(rows.items()), "doc_id long, text string")))}
    want = classes_of(rows)
    assert got == want and len({n for _, n in want.values()}) > 10


def test_near_copies_of_a_core_are_not_verified_in_pairs(spark, monkeypatch):
    base = [f"w{k}" for k in range(200)]
    docs = spark.createDataFrame([(k, " ".join([*base[:-1], f"end{k}"])) for k in range(3000)], "doc_id long, text string")
    cells = []
    monkeypatch.setattr(ngram_join, "_block_cells", lambda *a, f=ngram_join._block_cells: cells.append(f(*a).count()) or f(*a))
    got = rows_of(ngram_jaccard_join(docs))
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 2999)} and cells == [0]


def test_copies_around_a_text_that_is_no_document_grow_in_proportion(spark, monkeypatch):
    rng, base, cells = random.Random(6), [f"w{k}" for k in range(200)], []
    monkeypatch.setattr(ngram_join, "_block_cells", lambda *a, f=ngram_join._block_cells: cells.append(f(*a).count()) or f(*a))

    def edited(k, n):
        w = list(base)
        for x in rng.sample(range(5, 195), n):
            w[x] = f"x{k}-{x}"
        return k, " ".join(w)

    for n in (1000, 2000):
        got = rows_of(ngram_jaccard_join(spark.createDataFrame([edited(k, 2) for k in range(n)], "doc_id long, text string")))
        assert {r["class_id"] for r in got} == {0} and min(r["n_links"] for r in got) == n - 1
    assert len(cells) == 2 and cells[1] <= 2.2 * max(cells[0], 500)  # in pairs it would be 4, and over 30,000 at first
    # Two texts, each the middle of its own copies: what the first consensus leaves over has one of its own.
    other = [f"v{k}" for k in range(200)]
    mixed = [edited(k, 1) for k in range(600)] + [(1000 + k, " ".join([*base[:150], *other[:50]][:-1] + [f"e{k}"])) for k in range(400)]
    texts = dict(mixed)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows_of(ngram_jaccard_join(spark.createDataFrame(mixed, "doc_id long, text string")))}
    assert got == {k: (0, 599) if k < 1000 else (1000, 399) for k in texts}


def test_jaccard_join_keeps_texts_of_one_id_apart(spark, docs):
    a, b, c = ("alpha beta gamma delta " + " ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (None, c), (None, c), (None, c + " end"), (4, a), (None, "  "), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    joined = ngram_jaccard_join(docs)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows_of(joined))
    assert got == Counter([(1, 1, 2), (2, 1, 2), (4, 1, 2), (1, 1, 1), (3, 1, 1), *[(None, None, 2)] * 3, *[(None, None, 0)] * 2, (5, 5, 0)])
    kept = keep_one_per_class(docs, joined)
    left = Counter((r["doc_id"], r["text"]) for r in rows_of(kept))
    end = [k for k in left if k[0] is None and k[1] and k[1].strip()]
    assert kept.columns == docs.columns and len(end) == 1 and end[0][1].startswith(c)
    assert left - Counter(end) == Counter([(1, a), (1, b), (None, "  "), (None, None), (5, "")])


def test_jaccard_join_of_text_ids(spark):
    rows = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "other")], "name string, body string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows_of(ngram_jaccard_join(rows, doc_id="name", text="body"))}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("c", 0)}


def test_jaccard_join_of_odd_rows(spark, odd, none):
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows_of(ngram_jaccard_join(odd)))
    assert got == Counter([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 3), (7, 6, 3), (7, 6, 3), (None, 6, 3), (8, 8, 0), (9, 9, 0)])
    assert ngram_jaccard_join(none).count() == 0


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 128


# Decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items: dict):
    words, hit, found = words_of(text), set(), set()
    at = defaultdict(list)
    for n in {min(13, len(w)) for w in items.values() if w}:
        for k in range(len(words) - n + 1):
            at[tuple(words[k : k + n])].append(k)
    for item, w in items.items():
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for p in at.get(tuple(w[k : k + n]), ()):
                hit.update(range(p, p + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


FACTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("most", [{}, {"max_broadcast_windows": 0}, {"max_broadcast_windows": 0, "max_broadcast_anchors": 0}])
def test_decontamination_equals_a_scan(spark, sf_dir, texts, docs, most):
    benchmark = table(spark, sf_dir, "benchmark")
    items = {r["item_id"]: words_of(r["text"]) for r in benchmark.collect()}
    got = rows_of(decontaminate(docs, benchmark, **most))
    assert len(got) == len(texts) and any(r["contaminated"] for r in got)
    for r in got:
        assert tuple(r[c] for c in FACTS) == contamination(texts[r["doc_id"]], items)
        assert sum(e - s for s, e in r["spans"]) == r["n_hit"]


@pytest.mark.parametrize("most", [{}, {"max_broadcast_windows": 0}, {"max_broadcast_windows": 0, "max_broadcast_anchors": 0}])
def test_decontamination_of_short_items_and_odd_rows(spark, odd, none, most):
    items = {1: "Two, THREE", 2: "word", 3: None, 4: "?!", 5: "b c d e f g h i j k l m n o", 6: "a b c d e f g h i j k l m", 7: "one two three"}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    own = {k: words_of(t) for k, t in items.items()}
    got = Counter((r["doc_id"], *(r[c] for c in FACTS)) for r in rows_of(decontaminate(odd, benchmark, **most)))
    assert got == Counter((k, *contamination(t, own)) for k, t in ODD)
    assert decontaminate(none, benchmark).count() == 0
    assert not any(r["contaminated"] for r in rows_of(decontaminate(odd, benchmark.limit(0))))
    kept = keep_clean(odd, benchmark)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 8, 9}


@pytest.mark.parametrize("most", [{}, {"max_broadcast_windows": 0}, {"max_broadcast_windows": 0, "max_broadcast_anchors": 0}])
def test_decontamination_judges_every_row_by_its_own_text(spark, most):
    item = "a b c d e f g h i j k l m n o p"
    rows = [(1, "four clean words here"), (1, item), (1, f"x {item} y"), (None, item), (None, "clean"), (2, "q w e r t z u i o p s d f g"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = {"i": words_of(item), None: words_of("q w e r t z u i o p s d f g")}
    benchmark = spark.createDataFrame([("i", item), (None, "q w e r t z u i o p s d f g"), ("null", None)], "item_id string, text string")

    def want(t):
        n, hit, _, _, bad = contamination(t, items)
        listed = ["i"] if contamination(t, {"i": items["i"]})[1] else []
        return n, hit, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bad

    got = Counter((r["doc_id"], *(r[c] for c in FACTS)) for r in rows_of(decontaminate(docs, benchmark, **most)))
    assert got == Counter((k, *want(t)) for k, t in rows)
    assert sorted(map(str, keep_clean(docs, benchmark, **most).collect())) == sorted(str(r) for r in docs.collect() if not want(r["text"])[4])


def test_a_million_windows_meet_the_texts_without_moving_positions(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.concat(F.lit("w"), (F.col("id") * 26 + i).cast("string")))
    benchmark = spark.range(0, 75_000, 1, 8).select(F.col("id").alias("item_id"), F.array_join(words, " ").alias("text"))
    lines = [" ".join(f"w{k}" for k in range(lo, lo + 40)) for lo in (5, 26 * 70_000 + 3)]
    docs = spark.createDataFrame([(1, lines[0]), (2, "none of these words " * 10), (3, lines[1]), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in rows_of(decontaminate(docs, benchmark))}
    hit = lambda lo: len({p for at in range(lo, lo + 28) if at // 26 == (at + 12) // 26 for p in range(at, at + 13)})
    assert got == {1: hit(5), 2: 0, 3: hit(26 * 70_000 + 3), 4: 0}
    found = decontamination.scan(docs, decontamination.benchmark_windows(benchmark.limit(50)), max_broadcast_windows=0)[1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not any("Exchange hashpartitioning(anchor" in line for line in plan.splitlines())


def test_batches_are_made_in_slices():
    sizes = []

    def make(batches):
        for b in batches:
            sizes.append(b.num_rows)
            yield b

    rows = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 1, 2500)]
    assert [x for b in sliced(make)(iter(rows)) for x in b.column("x").to_pylist()] == [0, *range(2500)]
    assert max(sizes) <= SLICE_ROWS


def test_signatures_and_sets_are_made_in_slices(spark, docs, monkeypatch):
    made = []
    monkeypatch.setattr(ngram_join, "sliced", lambda f: made.append(f.__qualname__.split(".")[0]) or sliced(f))
    ngram_jaccard_join(docs).count()
    assert {"_signer", "_set_maker", "_verifier"} <= set(made)


def test_an_edited_passage_is_found_behind_many_holders_of_its_parts(spark):
    rng, rows, want, new = random.Random(5), [], {}, iter(range(10**7))
    words = lambda n, c="w": [f"{c}{next(new)}" for _ in range(n)]
    for _ in range(5):
        base = words(56)
        edited = [f"e{next(new)}" if rng.random() < 0.08 else w for w in base]
        parts = [*[base[:30]] * 10, *[base[26:]] * 10]
        for part in (*parts, base, edited):
            rows.append((len(rows), " ".join(words(20, "x") + part + words(20, "y"))))
        want[len(rows) - 1] = len(rows) - 2
    got = rows_of(fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert want.items() <= {(r["doc_id"], r["source_id"]) for r in got}


def test_toxicity_features_are_counted_in_little_memory():
    from tesserae.llm.toxicity import BUCKETS, _count_features, word_features

    texts = [" ".join(hashlib.md5(f"{t} {k}".encode()).hexdigest() for k in range(500)) for t in range(60)]
    batch = pa.RecordBatch.from_pydict({"text": [*texts, None, ""], "y": [k % 2 for k in range(62)]})
    tracemalloc.start()
    got = {f: (a, b) for out in _count_features([batch]) for f, a, b in zip(*(out.column(c).to_pylist() for c in ("f", "n0", "n1")), strict=True) if f < BUCKETS // 64}
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = defaultdict(lambda: [0, 0])
    for k, t in enumerate(texts):
        for f in set().union(*(word_features(w) for c in t.split() for w in WORD.findall(c))):
            want[f][k % 2] += 1
    assert got == {f: tuple(n) for f, n in want.items() if f < BUCKETS // 64}
    assert most < 40e6, most  # 17 MB of it are the counts


def test_a_task_leaves_no_cache_beside_the_next_operators():
    from tesserae.llm import words
    from tesserae.llm.common import only_cache

    enc = encoding.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    enc.count("one two")
    words.word_hashes("three four")
    assert encoding.encoder(public_tokenizers.path("byte_bpe_50k.json")) is enc and not words._WORDS
    words.word_hashes("three four")
    list(ToxicityModel((), (), 0.0).scorer()(["five"]))
    only_cache("words")
    assert words._WORDS and not encoding._LOADED
    only_cache()
    assert not words._WORDS


def test_documents_that_share_a_short_line_meet_in_turns_of_bounded_size(spark, monkeypatch):
    line, sizes = own("line", 24), []
    edited = [w if k % 12 else f"e{k}" for k, w in enumerate([*own("u", 16), *line, *own("v", 16)])]
    rows = [(k, own(("a", k), 20) + line + own(("b", k), 20)) for k in range(60)]
    rows += [(60, own("c", 20) + own("u", 16) + line + own("v", 16)), (61, own("d", 20) + edited)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    inner = chaining._aligned

    def aligned(plain, matches, k, **more):
        if more.get("made_tables") is not None:
            sizes.append(matches.count())
        return inner(plain, matches, k, **more)

    monkeypatch.setattr(chaining, "_aligned", aligned)
    whole = sorted(map(str, fuzzy_passages(docs).collect()))
    assert any("doc_id=61" in r and "source_id=60" in r for r in whole)
    most = max(sizes)
    sizes.clear()
    monkeypatch.setattr(chaining, "MATCHES_AT_ONCE", most // 2)
    assert sorted(map(str, fuzzy_passages(docs).collect())) == whole
    assert len(sizes) > 2 and max(sizes) <= 0.75 * most, (most, sizes)


def test_a_materialized_table_leaves_no_shuffle_files(spark):
    from tesserae.llm.common import CLEANUP, materialize

    seen, before = [], spark.conf.get(CLEANUP)
    df = spark.range(1000).repartition(3, "id")
    write = type(df.write).parquet
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(df.write), "parquet", lambda self, path: seen.append(spark.conf.get(CLEANUP)) or write(self, path))
        assert materialize(df, "x").count() == 1000
    assert seen == ["true"] and spark.conf.get(CLEANUP) == before


def test_documents_that_share_a_short_line_are_not_chained_in_pairs(spark, monkeypatch):
    line, sizes = own("short line", 17), []
    edited = [w if k % 12 else f"e{k}" for k, w in enumerate([*own("u", 20), *line, *own("v", 19)])]
    rows = [(k, own(("a", k), 20) + line + own(("b", k), 20)) for k in range(60)]
    rows += [(60, own("c", 20) + own("u", 20) + line + own("v", 19)), (61, own("d", 20) + edited)]
    inner = chaining._aligned

    def aligned(plain, matches, k, **more):
        if more.get("made_tables") is not None:
            sizes.append(matches.select(*chaining.PAIR).distinct().count())
        return inner(plain, matches, k, **more)

    monkeypatch.setattr(chaining, "_aligned", aligned)
    got = rows_of(fuzzy_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")))
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(61, 60)}
    assert len(sizes) == 2 and sizes[0] > 100 and sizes[1] < 20, sizes  # of 1,830 pairs


@pytest.mark.parametrize("cells", [1 << 22, 50])
def test_shared_items_are_counted_like_sets(monkeypatch, cells):
    monkeypatch.setattr(chaining, "CELLS", cells)
    rng = np.random.default_rng(1)
    for n_q, n_t, kinds in ((5, 7, 40), (60, 200, 3000), (1, 1, 50), (20, 30, 10**6)):
        q, t = ([np.unique(rng.integers(-kinds, kinds, rng.integers(0, 60))).astype(np.int32) for _ in range(n)] for n in (n_q, n_t))
        flat = lambda x: (np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x]), len(x))
        for least in (1, 3, 10):
            got = sorted((int(a), int(b)) for i, j in chaining.shared_items(*flat(q), *flat(t), least) for a, b in zip(i, j, strict=True))
            assert got == [(i, j) for i in range(n_q) for j in range(n_t) if len(np.intersect1d(q[i], t[j])) >= least]


def test_a_passage_shares_as_many_runs_around_a_seed_as_is_asked():
    least, around = chaining._bounds(50, 0.8, 60)
    assert (least, around) == (19, 122)
    rng, new = random.Random(8), iter(range(10**6))
    for _ in range(300):
        base = [f"w{next(new)}" for _ in range(rng.choice([50, 55, 70, 99]))]
        out, left_q, left_t = [], len(base) // 5, len(base) // 5  # words that may be left out, and put in
        for w in base:
            if left_t and rng.random() < 0.3:
                out.append(f"e{next(new)}")
                left_t -= 1
            if left_q and rng.random() < 0.25:
                left_q -= 1
            else:
                out.append(w)
        hits = len(set(base) & set(out))
        if hits >= 0.8 * max(len(base), len(out)):
            assert len(set(zip(base, base[1:])) & set(zip(out, out[1:]))) >= least


def test_word_codes_tell_the_same_words_apart(texts):
    from tesserae.llm import words

    some = [*texts.values(), None, "", " \n", "a\0 a a\0\0", "İstanbul　x y \ud800", " ".join(f"W{k}" for k in range(9000)), "z" * 9000 + " q"]
    both = [(words.word_hashes(t), words.word_codes(t)) for t in some]
    assert all(len(a) == len(b) for a, b in both)
    a, b = (np.concatenate(x) for x in zip(*both, strict=True))
    assert len(np.unique(a)) == len(np.unique(b)) == len(set(zip(a.tolist(), b.tolist(), strict=True)))


def test_surroundings_of_a_line_are_dealt_in_turns_of_bounded_size(spark, monkeypatch):
    """What lies on disk at once must not grow with the cells that a large group's rows go to."""
    line, dealt = own("long line", 24), []
    edited = [w if k % 12 else f"e{k}" for k, w in enumerate([*own("u", 16), *line, *own("v", 16)])]
    rows = [(k, own(("a", k), 20) + line + own(("b", k), 20)) for k in range(60)]
    rows += [(60, own("c", 20) + own("u", 16) + line + own("v", 16)), (61, own("d", 20) + edited)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    inner, counted = chaining._alike, spark.sparkContext.accumulator(0)

    def alike(least):
        def make(batches, f=inner(least)):
            def seen():
                for b in batches:
                    counted.add(b.num_rows)
                    yield b

            yield from f(seen())

        return make

    def materialize(df, name, f=chaining.materialize):
        before, out = counted.value, f(df, name)
        if name == "alike":
            dealt.append(counted.value - before)
        return out

    monkeypatch.setattr(chaining, "_alike", alike)
    monkeypatch.setattr(chaining, "materialize", materialize)
    whole = sorted(map(str, fuzzy_passages(docs).collect()))
    assert any("doc_id=61" in r and "source_id=60" in r for r in whole) and len(dealt) == 1
    for name, value in (("TOGETHER", 16), ("AROUND_AT_ONCE", 64), ("AROUND_SHARE", 1 << 30)):
        monkeypatch.setattr(chaining, name, value)
    dealt.clear()
    assert sorted(map(str, fuzzy_passages(docs).collect())) == whole
    assert len(dealt) > 4 and max(dealt) <= 0.6 * sum(dealt), dealt


def test_seeds_that_the_same_documents_hold_side_by_side_are_one_line(spark):
    at = {1: 10, 2: 14, 3: 17, 4: 90}
    held = [(seed, d, 0, pos + d) for seed, pos in at.items() for d in range(20)] + [(5, d, 0, 18 + d) for d in range(12)]
    lines = dict(chaining._lines(spark.createDataFrame(held, "seed long, source long, source_part int, tpos int"), 122).collect())
    assert lines == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
