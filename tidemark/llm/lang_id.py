"""Language identification that asks whole words first and backs off to shorter character n-grams.

Training counts words, and the character n-grams of words with a space at both ends, per
language over a bounded sample of labelled rows: `max_rows_per_lang` of each language, picked by
a hash of the row. Nothing else bounds the model: every word and n-gram of the sample, and every
language, is in it. It is a table of hashed items, each with the languages that have it.

A known word scores the log relative frequency that each language gives it. An unseen word
is scored by its known n-grams of the longest length that has any, averaged. A language
without the item scores a fixed penalty. The text's language has the largest sum; of equal sums the
first by name.

A letter is a character of a Unicode letter category, in training and in prediction; digits,
fractions and numerals are none. Null text and text without a letter give "und" with score
0, as does a model without any labelled row. A very long text is scored whole. Rows are independent; repeated
rows and ids change nothing. An empty table gives no rows. Extra columns may be kept; columns named
lang_pred or score give way to the results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, packed, ragged_take, scratch_table, unpacked, worker_state

LETTERS = regex.compile(r"\p{L}+")
#: How many words a worker remembers.
MEMORY = 100_000


def item_hash(item: str) -> int:
    """Spark's xxhash64 of the item, as unsigned."""
    return xxhash.xxh64_intdigest(item.encode("utf-8", "surrogatepass"), 42)


class Model:
    """Per level (0: words, n: n-grams of that length) hashed items, ascending; the languages that have each and how far each lies above its floor."""

    def __init__(self, langs: list[str], levels: list[dict]):
        self.langs, self.levels = langs, levels




def train(labelled: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", max_rows_per_lang: int = 4000, longest: int = 5) -> Model:
    """Fit on rows with a non-null language."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = scratch_table(rows.groupBy("lang").agg(F.count("*").alias("rows")), "lang-rows")
    langs = [r["lang"] for r in sizes.select("lang").orderBy("lang").collect()]
    if not langs:
        forget(sizes)
        return Model([], [])
    # no row moves to be sampled: the table of languages is small
    share = F.least(F.lit(1.0), F.lit(float(max_rows_per_lang)) / F.col("rows")) * (1 << 30)
    sample = rows.join(sizes, "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share)
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("item"))
    words = scratch_table(words.groupBy("lang", "item").agg(F.count("*").alias("n")), "lang-words")
    padded = words.select("lang", "n", F.concat(F.lit(" "), "item", F.lit(" ")).alias("w"))
    cut = f"flatten(transform(sequence(1, least({longest}, length(w))), k -> transform(sequence(1, length(w) - k + 1), i -> named_struct('k', k, 'item', substring(w, i, k)))))"
    grams = padded.select("lang", "n", F.explode(F.expr(cut)).alias("g"))
    counted = grams.groupBy("lang", F.col("g.k").alias("k"), F.col("g.item").alias("item")).agg(F.sum("n").alias("n"))
    every = scratch_table(words.select("lang", F.lit(0).alias("k"), "item", "n").unionByName(counted).select("lang", "k", F.xxhash64("item").alias("h"), "n"), "lang-items")
    at = {x: i for i, x in enumerate(langs)}
    levels = []
    for k in range(longest + 1):
        # bounded by the sample; the driver sees hashes and counts only
        got = every.filter(F.col("k") == k).select("h", "lang", "n").toArrow()
        h = got.column("h").to_numpy().view(np.uint64)
        names = got.column("lang").combine_chunks().dictionary_encode() if got.num_rows else None
        of = np.array([at[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if names is not None else np.zeros(0, np.int64)
        n = got.column("n").to_numpy().astype(np.float64)
        total = np.bincount(of, weights=n, minlength=len(langs))
        # a language without the item: rarer than its rarest one
        floor = np.minimum(np.log10(0.5 / np.maximum(total, 1)), -6.5 if k == 0 else -5.5)
        by = np.lexsort((of, h))
        h, of, n = h[by], of[by], n[by]
        keys, starts = np.unique(h, return_index=True)
        levels.append({"keys": keys, "starts": np.append(starts, len(h)).astype(np.int64), "lang": of.astype(np.int32), "above": (np.log10(n / total[of]) - floor[of]).astype(np.float32), "floor": floor})
    forget(sizes, words, every)
    return Model(langs, levels)


class Scorer:
    """Scores texts in a worker; what words met say is remembered, up to MEMORY words."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        new: list[str] = []

        class Rows(dict):
            def __missing__(self, word):
                new.append(word)
                self[word] = row = len(self)
                return row

        self.rows, self.new = Rows(), new
        # of each remembered word its level (or one past the last, if nothing is known) and what languages have above their floors
        self.level = np.zeros(0, np.int64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.lang, self.above = np.zeros(0, np.int32), np.zeros(0, np.float32)

    def _learn(self) -> None:
        words, many = self.new, len(self.model.langs)
        level = np.full(len(words), len(self.model.levels), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, language, above
        left = np.arange(len(words))
        for k in [0, *range(len(self.model.levels) - 1, 0, -1)]:
            table = self.model.levels[k]
            if not len(left) or not len(table["keys"]):
                continue
            if k == 0:
                items, owner = [words[i] for i in left.tolist()], left
            else:
                cuts = [[p[i : i + k] for i in range(len(p) - k + 1)] for p in (f" {words[i]} " for i in left.tolist())]
                if k == 1:
                    # the padding alone says nothing
                    cuts = [c[1:-1] for c in cuts]
                items, owner = [g for c in cuts for g in c], np.repeat(left, list(map(len, cuts)))
            keys = np.fromiter(map(item_hash, items), np.uint64, len(items))
            near = np.minimum(np.searchsorted(table["keys"], keys), len(table["keys"]) - 1)
            hit = table["keys"][near] == keys
            near, owner = near[hit], owner[hit]
            if not len(owner):
                continue
            n = np.bincount(owner, minlength=len(words))
            size = table["starts"][near + 1] - table["starts"][near]
            lang = ragged_take(table["starts"], np.diff(table["starts"]), table["lang"], near)
            above = ragged_take(table["starts"], np.diff(table["starts"]), table["above"], near) / n[np.repeat(owner, size)]
            place, back = np.unique(np.repeat(owner, size) * many + lang, return_inverse=True)
            found.append((place // many, place % many, np.bincount(back, weights=above)))
            known = np.unique(owner)
            level[known] = k
            left = np.setdiff1d(left, known, assume_unique=True)
        word, lang, above = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        by = np.argsort(word, kind="stable")
        sizes = np.bincount(word, minlength=len(words))
        starts = len(self.lang) + np.cumsum(sizes) - sizes
        self.level = np.concatenate((self.level, level))
        self.starts, self.sizes = np.concatenate((self.starts, starts)), np.concatenate((self.sizes, sizes))
        self.lang, self.above = np.concatenate((self.lang, lang[by].astype(np.int32))), np.concatenate((self.above, above[by].astype(np.float32)))
        self.new.clear()

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, find = self.model.langs, LETTERS.findall
        if len(self.rows) > MEMORY:
            self.reset()
        row = self.rows.__getitem__
        at = [np.array(list(map(row, find(t.lower()))), np.int64) if t and langs else np.zeros(0, np.int64) for t in texts]
        if self.new:
            self._learn()
        floors = np.stack([t["floor"] for t in self.model.levels] + [np.zeros(len(langs))]) if langs else None
        names, scores = [], []
        for rows in at:
            if not len(rows):
                names.append("und")
                scores.append(0.0)
                continue
            total = np.bincount(self.level[rows], minlength=len(floors)) @ floors
            total = total + np.bincount(ragged_take(self.starts, self.sizes, self.lang, rows), weights=ragged_take(self.starts, self.sizes, self.above, rows), minlength=len(langs))
            best = int(total.argmax())
            # words of a text are not independent, so the evidence is tempered
            names.append(langs[best])
            scores.append(float(1 / np.exp(np.maximum((total - total[best]) * 0.5, -700)).sum()))
        return names, scores


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns (all of `docs` by default) with lang_pred and score."""
    spark = docs.sparkSession
    # arrays of a bounded sample
    shared = spark.sparkContext.broadcast((model.langs, model.levels))
    key = shared._jbroadcast.id()
    kept = docs.select(packed(docs, keep, "lang_pred", "score"), F.col(text).cast("string").alias("__whole"))
    schema = kept.drop("__whole").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        scorer = worker_state(("language", key), lambda: Scorer(Model(*shared.value)))
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                part = batch.slice(lo, 250)
                langs, scores = scorer.score(part.column("__whole").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("__row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["__row", "lang_pred", "score"])

    return unpacked(kept.mapInArrow(run, schema), "lang_pred", "score")


def trains_on(doc_id: Column, folds: int = 4, held: int = 2) -> Column:
    """True for the rows that may be learned from: crc32 of the id as text, modulo `folds`, isn't `held`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != held
