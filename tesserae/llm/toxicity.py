"""A counterfactual-regularised toxicity classifier.

Texts are sets of hashed features of their words: the word, its beginnings of 3 to 6 letters and its 5-letter parts.
Features that tell the labels apart are selected by a smoothed log-odds z-score from counts over the training rows, and
those of the group terms go with them; a logistic model is fitted on both. Counterfactual sentences swap a group term of
a labelled sentence for the others of its class and for a neutral word, and the squared change of the logit is part of
the loss. Since texts may name no group at all, a drawn sentence of every labelled row also gets a drawn term at a drawn
place, which is then swapped likewise. So a group's mention alone cannot move a score, whatever words surround it.

Only the text is an input of a score.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import SLICE_ROWS, drop_materialized, materialize, only_cache, sliced

# Group names by language and class, each with a neutral word first. Pass your own as `identity_terms`.
IDENTITY_TERMS = {
    "en religion": ("person", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    "en gender": ("person", "woman", "man", "girl", "boy", "female", "male", "transgender"),
    "en orientation": ("person", "gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual"),
    "en origin": ("person", "african", "american", "arab", "asian", "black", "european", "immigrant", "indian", "latino", "mexican", "refugee", "white"),
    "en people": ("people", "muslims", "christians", "jews", "women", "men", "gays", "lesbians", "immigrants", "refugees", "blacks", "whites", "asians", "arabs"),
    "en ability": ("person", "blind", "deaf", "disabled", "autistic", "elderly", "old", "young"),
    "fr religion": ("personne", "musulman", "musulmane", "chrétien", "chrétienne", "juif", "juive", "hindou", "bouddhiste", "athée", "catholique"),
    "fr gender": ("personne", "femme", "homme", "fille", "garçon", "transgenre"),
    "fr orientation": ("personne", "gay", "lesbienne", "bisexuel", "homosexuel", "hétérosexuel"),
    "fr origin": ("personne", "africain", "américain", "arabe", "asiatique", "noir", "blanc", "européen", "immigré", "indien", "réfugié"),
    "fr ability": ("personne", "aveugle", "sourd", "handicapé", "autiste", "vieux", "jeune"),
    "de religion": ("person", "muslim", "muslimin", "christ", "christin", "jude", "jüdin", "hindu", "buddhist", "atheist", "katholik"),
    "de gender": ("person", "frau", "mann", "mädchen", "junge", "transgender"),
    "de orientation": ("person", "schwul", "lesbisch", "bisexuell", "homosexuell", "heterosexuell"),
    "de origin": ("person", "afrikaner", "amerikaner", "araber", "asiate", "schwarzer", "weißer", "europäer", "einwanderer", "inder", "flüchtling"),
    "de ability": ("person", "blind", "taub", "behindert", "autistisch", "alt", "jung"),
    "es religion": ("persona", "musulmán", "musulmana", "cristiano", "cristiana", "judío", "judía", "hindú", "budista", "ateo", "católico"),
    "es gender": ("persona", "mujer", "hombre", "chica", "chico", "transgénero"),
    "es orientation": ("persona", "gay", "lesbiana", "bisexual", "homosexual", "heterosexual"),
    "es origin": ("persona", "africano", "americano", "árabe", "asiático", "negro", "blanco", "europeo", "inmigrante", "indio", "refugiado"),
    "es ability": ("persona", "ciego", "sordo", "discapacitado", "autista", "viejo", "joven"),
}
BUCKETS = 1 << 20
#: Documents that training reads at most (about; rows are chosen by a hash of their id) and features that it keeps.
TRAIN_ROWS, MAX_FEATURES = 20_000, 4096
#: Counterfactuals of a row that the fit reads at most; of more, those with the smallest hashes.
SWAPS_PER_ROW = 32
#: Chunks that a task's cache holds at most, and their length.
CACHED_CHUNKS, CACHED_LENGTH = 100_000, 64
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
THRESHOLD = 0.3


def word_features(word: str) -> set[int]:
    """Buckets of one lower-cased word."""
    parts = {"w" + word}
    parts.update("p" + word[:k] for k in range(3, min(6, len(word)) + 1))
    edged = f"^{word}$"
    parts.update("g" + edged[k : k + 5] for k in range(len(edged) - 4))
    return {zlib.crc32(p.encode()) & (BUCKETS - 1) for p in parts}


def _features(chunk: str) -> set[int]:
    return set().union(*map(word_features, WORD.findall(chunk)))


def _of_chunks(text: str, cache: dict, make) -> Iterator:
    """What `make` gives for each distinct white-space chunk of a text. The cache is bounded in chunks and in the length of each."""
    for chunk in set(text.lower().split()):
        found = cache.get(chunk)
        if found is None:
            found = make(chunk)
            if len(chunk) <= CACHED_LENGTH:
                if len(cache) >= CACHED_CHUNKS:
                    cache.clear()
                cache[chunk] = found
        yield found


def counterfactuals(text: str, classes: dict[str, tuple[str, ...]]) -> set[tuple[str, str]]:
    """(sentence, swapped sentence) for every group term in every sentence and every other term of each of its classes.

    One drawn sentence also gets a drawn term between two drawn words, and that one swapped; draws follow from the text.
    """
    where: dict[str, set[str]] = {}
    for k, terms in classes.items():
        for t in terms[1:]:
            where.setdefault(t, set()).add(k)
    sentences = SENTENCE.split(text.lower())
    named = [(s, t, k) for s in sentences for t in set(WORD.findall(s)) & where.keys() for k in where[t]]
    if where:
        h = zlib.crc32(text.encode("utf-8", "surrogatepass"))
        words = sentences[h % len(sentences)].split()
        kind = sorted(k for k, terms in classes.items() if terms[1:])[h // 7 % sum(bool(t[1:]) for t in classes.values())]
        term = classes[kind][1:][h // 1009 % len(classes[kind][1:])]
        at = h // 31 % (len(words) + 1)
        named.append((" ".join([*words[:at], term, *words[at:]]), term, kind))
    return {(s, re.sub(rf"(?<![^\W\d_]){t}(?![^\W\d_])", other, s)) for s, t, k in named for other in classes[k] if other != t}


@dataclass(frozen=True)
class ToxicityModel:
    features: tuple[int, ...]
    weights: tuple[float, ...]
    bias: float

    def scorer(self):
        """A function of texts to scores, for one worker."""
        weight = dict(zip(self.features, self.weights, strict=True))
        place = {f: f for f in weight}  # so that the cache holds no numbers of its own
        cache: dict[str, tuple[int, ...]] = {}

        def score(texts):
            out = np.empty(len(texts))
            for k, t in enumerate(texts):
                found: set[int] = set()
                for chunk in set((t or "").lower().split()):
                    own = cache.get(chunk)
                    if own is None:
                        if len(cache) > 300_000:
                            cache.clear()
                        own = cache[chunk] = tuple([place[f] for f in _features(chunk) if f in place])
                    if own:
                        found.update(own)
                out[k] = self.bias + math.fsum(weight[f] for f in found)
            return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

        return score


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _count_features(batches):
    """Of one partition: how many rows of each label have a feature."""
    only_cache()
    counts, cache = np.zeros((2, BUCKETS), np.int64), {}
    packed = lambda chunk: array("I", _features(chunk)).tobytes()  # noqa: E731 -- a twelfth of a set of numbers
    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
            counts[y][np.unique(np.frombuffer(b"".join(_of_chunks(text or "", cache, packed)), np.uintc))] += 1
    at = np.nonzero(counts.sum(axis=0) > 0)[0]
    for k in range(0, len(at), 50_000):
        own = at[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(counts[0][own], pa.int64()), pa.array(counts[1][own], pa.int64())], ["f", "n0", "n1"])


def _selected_rows(chosen: dict[int, int], classes: dict[str, tuple[str, ...]], swaps_per_row: int):
    """Rows of the fit: label and selected features of a text, and label -1 with what each side of a counterfactual has alone."""
    kind = pa.list_(pa.int32())

    def rows(batches):
        only_cache()
        cache: dict[str, tuple[int, ...]] = {}
        make = lambda chunk: tuple(chosen[f] for f in _features(chunk) if f in chosen)
        pick = lambda text: set().union(*_of_chunks(text, cache, make))
        for b in batches:
            ys, own, swapped = [], [], []
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                ys.append(y)
                own.append(sorted(pick(text or "")))
                swapped.append([])
                made = counterfactuals(text or "", classes)
                if len(made) > swaps_per_row:
                    made = sorted(made, key=lambda p: zlib.crc32("\n".join(p).encode("utf-8", "surrogatepass")))[:swaps_per_row]
                for s, c in made:
                    a, c = pick(s), pick(c)
                    if a != c:
                        ys.append(-1)
                        own.append(sorted(a - c))
                        swapped.append(sorted(c - a))
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(own, kind), pa.array(swapped, kind)], ["y", "own", "swapped"])

    return rows


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, max_features: int = MAX_FEATURES, penalty: float = 1.0, ridge: float = 1e-3, steps: int = 300, swaps_per_row: int = SWAPS_PER_ROW, identity_terms: dict[str, tuple[str, ...]] | None = None) -> ToxicityModel:
    """Fit on about `train_rows` labelled rows that are not held out, chosen by the hash of their id.

    These bounds hold for the fit alone: `train_rows` labelled rows, `swaps_per_row` counterfactuals of each, and
    `max_features` features besides those of `identity_terms`. Counterfactuals that change the same features are one
    with a weight, so what reaches the driver is bounded by the three.

    Rows whose label is not 0 or 1, or without an id, teach nothing; repeated rows count as often as they occur. With
    one label only (or none) the model has no features and its score is the smoothed share of label 1.
    """
    classes = IDENTITY_TERMS if identity_terms is None else identity_terms
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y"))
    total = known.count()
    share = min(1.0, train_rows / max(total, 1))
    known = known.where(F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit("train")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(known, "__id").select("text", "y")
    rows = materialize(rows, "toxicity-rows")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    prior = math.log((n1 + 1) / (n0 + 1))
    if not n0 or not n1:
        drop_materialized(rows)
        return ToxicityModel((), (), prior)
    counts = rows.mapInArrow(sliced(_count_features), "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    odds = F.log((F.col("b") + 0.5) / (n1 - F.col("b") + 0.5)) - F.log((F.col("a") + 0.5) / (n0 - F.col("a") + 0.5))
    spread = F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("a") + 0.5))
    z = F.abs(odds / spread)
    best = counts.where(F.col("a") + F.col("b") >= 3).select("f", z.alias("z")).where("z > 3").orderBy(F.desc("z"), "f").limit(max_features)
    named = {f for terms in classes.values() for t in terms for f in word_features(t)}
    features = sorted({r[0] for r in best.collect()} | named)
    chosen = {f: k for k, f in enumerate(features)}
    got = rows.mapInArrow(sliced(_selected_rows(chosen, classes, swaps_per_row)), "y int, own array<int>, swapped array<int>")
    # Equal rows meet as one with a weight.
    got = got.groupBy("y", "own", "swapped").agg(F.count("*").alias("n")).orderBy("y", "own", "swapped").toArrow()
    weights, bias = _descend(got, len(features), prior, penalty, ridge, steps)
    drop_materialized(rows)
    keep = [k for k in range(len(features)) if abs(weights[k]) > 1e-6]
    return ToxicityModel(tuple(features[k] for k in keep), tuple(float(weights[k]) for k in keep), float(bias))


def _descend(rows: pa.Table, n_features: int, prior: float, penalty: float, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent (Adam) on log loss + penalty * squared logit change + ridge."""
    is_real = pc.greater_equal(rows["y"], 0)
    real, swap = rows.filter(is_real), rows.filter(pc.invert(is_real))

    def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), pc.list_flatten(lists).to_numpy()

    r_row, r_col = flat(real["own"])
    a_row, a_col = flat(swap["own"])
    b_row, b_col = flat(swap["swapped"])
    y, n, m = real["y"].to_numpy().astype(float), real["n"].to_numpy().astype(float), swap["n"].to_numpy().astype(float)
    w, bias = np.zeros(n_features), prior
    first, second, fb, sb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, steps + 1):
        z = bias + np.bincount(r_row, w[r_col], real.num_rows)
        g = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n.sum()
        grad = np.bincount(r_col, g[r_row], n_features) + ridge * w
        if swap.num_rows:
            d = np.bincount(a_row, w[a_col], swap.num_rows) - np.bincount(b_row, w[b_col], swap.num_rows)
            e = 2 * penalty * m * d / m.sum()
            grad += np.bincount(a_col, e[a_row], n_features) - np.bincount(b_col, e[b_row], n_features)
        gb = g.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        fb, sb = 0.9 * fb + 0.1 * gb, 0.999 * sb + 0.001 * gb**2
        rate = 0.1 / (1 - 0.9**t)
        fix = math.sqrt(1 - 0.999**t)
        w = w - rate * fix * first / (np.sqrt(second) + 1e-8)
        bias -= rate * fix * fb / (math.sqrt(sb) + 1e-8)
    return w, bias


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted. Null and empty texts get the score of no features."""

    def scored(batches):
        only_cache()
        of = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(of(b.column("text").to_pylist()), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(sliced(scored), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, that score below the threshold: a filter inside the scan's stage."""

    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only_cache()
        of = model.scorer()
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(of(texts.slice(lo, SLICE_ROWS).to_pylist()) for lo in range(0, len(texts), SLICE_ROWS))]))
        pa.default_memory_pool().release_unused()

    toxicity = F.arrow_udf(toxicity, "double")
    return docs.where(toxicity(F.col(text)) < threshold)
