"""The token space: ids, their text, and word-level look-up.

Ids follow from the codebook's shape (K codes, position levels, levels of the other channels), so every table is built
from a rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ids of the special tokens and of the atoms.
PAD, BOS, EOS, NEWLINE, ATOMS, ATOMS_END, POS, POS_END, FORCE, FORCE_END, ENERGY, ENERGY_END = range(12)
SPECIAL_TEXT = ("[PAD]", "[BOS]", "[EOS]", "[NL]", "[ATOMS]", "[ATOMS_END]", "[POS]", "[POS_END]", "[FORCE]", "[FORCE_END]", "[ENERGY]", "[ENERGY_END]")
FIRST_ATOM, N_ATOMS = 12, 118
FIRST_CODE = FIRST_ATOM + N_ATOMS
UNKNOWN = "[UNK]"
#: Words of a vocabulary that goes to every task: some 100 bytes each.
MAX_WORDS = 500_000


@dataclass(frozen=True)
class Space:
    """Where each channel's ids start."""

    size: int = 256
    pos_levels: int = 8
    levels: int = 4

    @property
    def pos(self) -> int:
        return FIRST_CODE

    def channel(self, k: int) -> int:
        """Start of fx, fy, fz (k = 0, 1, 2) and energy (3)."""
        return FIRST_CODE + self.pos_levels * self.size + k * self.levels * self.size

    @property
    def vocab_size(self) -> int:
        return self.channel(4)

    def tokens(self, atoms: int) -> int:
        """Length of a molecule's sequence."""
        return atoms * (self.pos_levels + 3 * self.levels + 3) + self.levels + 11


def token_text(token: Column, space: Space) -> Column:
    """The text of a token id; ids outside the vocabulary show as unknown."""
    out = F.when((token < 0) | (token >= space.vocab_size), F.concat(F.lit("[UNK:"), token.cast("string"), F.lit("]")))
    for k, text in enumerate(SPECIAL_TEXT):
        out = out.when(token == k, F.lit(text))
    out = out.when(token < FIRST_CODE, F.concat(F.lit("[Z="), (token - FIRST_ATOM + 1).cast("string"), F.lit("]")))

    def coded(name: str, start: int) -> Column:
        level, code = F.floor((token - start) / space.size), F.pmod(token - F.lit(start), F.lit(space.size))
        return F.concat(F.lit(f"[{name}"), level.cast("string"), F.lit(":"), code.cast("string"), F.lit("]"))

    out = out.when(token < space.channel(0), coded("P", space.pos))
    for k, name in enumerate(("FX", "FY", "FZ")):
        out = out.when(token < space.channel(k + 1), coded(name, space.channel(k)))
    return out.otherwise(coded("E", space.channel(3)))


def vocabulary(spark: SparkSession, space: Space, unknown: bool = False) -> DataFrame:
    """(token_id, token) of the whole vocabulary; `unknown` appends the unknown word at the end, as word-level tokenizers want it."""
    rows = spark.range(space.vocab_size).select(F.col("id").cast("int").alias("token_id"))
    rows = rows.withColumn("token", token_text(F.col("token_id"), space))
    if unknown:
        rows = rows.unionByName(spark.range(1).select(F.lit(space.vocab_size).alias("token_id"), F.lit(UNKNOWN).alias("token")))
    return rows


def vocabulary_info(spark: SparkSession, space: Space) -> DataFrame:
    """What describes the vocabulary, in one row."""
    s = space
    row = (s.vocab_size, s.size, s.pos_levels, s.levels, FIRST_ATOM, s.pos, s.channel(0), s.channel(1), s.channel(2), s.channel(3), PAD, BOS, EOS)
    names = "vocab_size codebook_size pos_levels n_levels atom_start pos_start fx_start fy_start fz_start energy_start pad_id bos_id eos_id"
    return spark.createDataFrame([row], ", ".join(f"{n} int" for n in names.split()))


def texts(space: Space) -> list[str]:
    """The texts of all ids, in order."""
    channels = [("P", space.pos_levels), *((n, space.levels) for n in ("FX", "FY", "FZ", "E"))]
    coded = [f"[{name}{level}:{code}]" for name, levels in channels for level in range(levels) for code in range(space.size)]
    return [*SPECIAL_TEXT, *(f"[Z={z}]" for z in range(1, N_ATOMS + 1)), *coded]


def tokens_to_text(tokens: Column, space: Space, pretty: bool = False) -> Column:
    """Token texts joined by spaces; `pretty` shows line ends as such. A token is one look-up in the vocabulary, a constant of the plan."""
    words = F.split(F.lit(" ".join(texts(space))), " ")
    text = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.get(words, t), F.concat(F.lit("[UNK:"), t.cast("string"), F.lit("]")))), " ")
    return F.replace(text, F.lit("[NL]"), F.lit("\n")) if pretty else text


def text_words(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_id_lists(docs: DataFrame, vocab: DataFrame, text: str, unknown_id: int, name: str = "ids") -> DataFrame:
    """`docs` with the ids of each text's words as a list: a look-up in a constant table inside the row, and no shuffle.

    The vocabulary (token, token_id) goes to the tasks whole, up to MAX_WORDS words; a larger one is refused (`word_ids`
    joins it). Null texts have no words.
    """
    rows = vocab.select("token", "token_id").limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words do not go to every task")
    table = {r["token"]: r["token_id"] for r in rows}

    @F.arrow_udf("array<int>")
    def ids(words: pa.Array) -> pa.Array:
        found = [table.get(w, unknown_id) for w in words.flatten().to_pylist()]
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(found, pa.int32()))

    return docs.withColumn(name, ids(F.coalesce(text_words(F.col(text)), F.array().cast("array<string>"))))


def word_ids(docs: DataFrame, vocab: DataFrame, key: str, text: str, unknown_id: int) -> DataFrame:
    """(key, pos, token_id): every word's id, `unknown_id` for words that the vocabulary (token, token_id) lacks. Null texts have no words.

    A vocabulary of more than MAX_WORDS words is joined by a shuffle of the words.
    """
    if vocab.limit(MAX_WORDS + 1).count() <= MAX_WORDS:
        return word_id_lists(docs.select(key, text), vocab, text, unknown_id, "__ids").select(key, F.posexplode("__ids").alias("pos", "token_id"))
    words = docs.select(key, F.posexplode(text_words(F.col(text))).alias("pos", "token"))
    return words.join(vocab, "token", "left").select(key, "pos", F.coalesce("token_id", F.lit(unknown_id)).cast("int").alias("token_id"))


def token_uses(tokens: DataFrame, space: Space, column: str = "tokens") -> DataFrame:
    """(token_id, token, n_uses) of the whole vocabulary over a table of token lists."""
    counts = tokens.select(F.explode(column).alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n_uses"))
    return vocabulary(tokens.sparkSession, space, unknown=True).join(counts, "token_id", "left").withColumn("n_uses", F.coalesce("n_uses", F.lit(0)))


def write_tokenizer(spark: SparkSession, space: Space, path: str) -> None:
    """The word-level vocabulary as JSON lines, with the roles of pad, bos, eos and unknown."""
    role = F.when(F.col("token_id") == PAD, "pad").when(F.col("token_id") == BOS, "bos").when(F.col("token_id") == EOS, "eos").when(F.col("token") == UNKNOWN, "unk")
    vocabulary(spark, space, unknown=True).withColumn("role", role).coalesce(1).write.mode("overwrite").json(path)
