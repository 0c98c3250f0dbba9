"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams (n = 1 to 3) in order of frequency. A text's
own most frequent n-grams are ranked likewise; the distance to a profile is the sum over these
n-grams of how far out of place each one is there, or the most it can be if it isn't there.
N-grams are packed exactly into 63 bits (21 for a code point) and counted by sorting, so that
a text of any length is taken whole with vectorised steps.
"""

from __future__ import annotations

import json
import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibloom.llm.common import map_batches

UNDETERMINED = "und"
#: N-grams of a profile and of a text's ranking.
PROFILE_SIZE = 300
#: At most so many labelled rows (those with the lowest hashes) are learned from.
FIT_ROWS = 20_000
#: At most so many languages; beyond that fitting fails rather than growing without bound.
MAX_LANGUAGES = 1_000

MASK = (1 << 21) - 1
#: Stands for the border of a word; above every code point.
BORDER = MASK

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or 0 for what is no letter."""
    if "letters" not in _tables:
        out = np.zeros(sys.maxunicode + 1, np.int64)
        for c in range(sys.maxunicode + 1):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = out
    return _tables["letters"]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Packed n-grams of a text and their counts, or None if it has no letter.

    Words are runs of letters with a border (0) on either side; n-grams don't reach over one,
    and a border alone isn't an n-gram.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.zeros(len(codes) + 2, np.int64)
    c[1:-1] = _letters()[codes]
    if not c.any():
        return None
    one = c[c > 0]
    a, b = c[:-1], c[1:]
    two = (a << 21 | b)[(a > 0) | (b > 0)]
    x, y, z = c[:-2], c[1:-1], c[2:]
    three = (x << 42 | y << 21 | z)[y > 0]
    # borders count as the code above all others, so that n-grams of different lengths differ
    two |= np.where(two >> 21 == 0, BORDER << 21, 0) | np.where(two & MASK == 0, BORDER, 0)
    three |= np.where(three >> 42 == 0, BORDER << 42, 0) | np.where(three & MASK == 0, BORDER, 0)
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def _top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by their packed value."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:size]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", rows: int = FIT_ROWS, size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """Profiles of the languages of the labelled rows: {lang: n-grams, most frequent first}.

    Rows without text, letters or lang are left out. Of more than ``rows`` rows it learns from
    those whose id has a hash in the share of the hash range that gives about so many; what
    comes back has at most ``size`` numbers a language.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = rows / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(F.lit("fit"), id_col), F.lit(1 << 32)) < int(share * (1 << 32)))
    chosen = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def start():
        def count(langs, texts):
            out: dict[str, list] = {}
            for name, t in zip(langs, texts, strict=True):
                if (found := ngrams(t)) is not None:
                    out.setdefault(name, []).append(found)
            names, grams, counts = [], [], []
            for name, parts in out.items():
                g, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
                names += [name] * len(g)
                grams += g.tolist()
                counts += n.tolist()
            return [names, grams, counts]

        return count

    totals = map_batches(chosen, start, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    ranked = totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    found: dict[str, list] = {}
    for r in ranked.limit(MAX_LANGUAGES * size + 1).collect():
        found.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {name: [g for _, g in sorted(found[name])] for name in sorted(found)}


class Profiles:
    """Profiles as one table from n-gram to its rank in each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([np.array(profiles[n], np.int64) for n in self.names] or [np.zeros(0, np.int64)]))
        #: one row more for n-grams of no profile
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), k] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the least distance, ties by name; score 1 is the same ranking."""
        found = ngrams(text) if text else None
        if found is None or not self.names:
            return UNDETERMINED, 0.0
        top = _top(*found, self.size)
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == top, at, len(self.grams))
        ranks = self.ranks[at]
        places = np.where(ranks >= 0, np.minimum(np.abs(ranks - np.arange(len(top))[:, None]), self.size), self.size)
        distance = places.sum(axis=0)
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (self.size * len(top)))


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predict(df: DataFrame, profiles: dict[str, list[int]], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, lang_pred, score) of every row, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0. Rows are taken one by one:
    repeated rows repeat, other columns are dropped, an empty table gives an empty result.
    Without any profile everything is ``und``.
    """
    shared = df.sparkSession.sparkContext.broadcast(json.dumps(profiles))

    def start():
        p = Profiles(json.loads(shared.value))

        def rows(ids, texts):
            found = [p.predict(t) for t in texts]
            return [ids, [f[0] for f in found], [f[1] for f in found]]

        return rows

    kind = dict(df.dtypes)[id_col]
    return map_batches(df.select(id_col, text), start, f"`{id_col}` {kind}, lang_pred string, score double")


def predict_rows(df: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, with lang_pred and score; columns of these names give
    way. Texts pass through the workers with their rows, so nothing is joined or shuffled."""
    df = df.drop("lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(json.dumps(profiles))
    place = df.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def start():
        p = Profiles(json.loads(shared.value))

        def rows(*columns):
            found = [p.predict(t) for t in columns[place]]
            return [*columns, [f[0] for f in found], [f[1] for f in found]]

        return rows

    return map_batches(df, start, f"{fields}, lang_pred string, score double")


def identify(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Learn from the rows that are not held out, predict every row: id_col, held_out,
    lang_pred, score."""
    profiles = fit(df.where(~held_out(F.col(id_col))), text, lang, id_col)
    found = predict(df, profiles, text, id_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
