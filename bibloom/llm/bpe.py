"""BPE encoding and decoding, and exact token counts at prefixes of a text.

A vocabulary file is read once on the driver and broadcast; each Python worker builds its
tables once. Encoding a word keeps its symbols in a doubly linked list and the mergeable pairs
in a priority queue of merge ranks; entries whose symbols have changed meanwhile are skipped.
Encoded words are remembered in two generations of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from itertools import accumulate, chain

import regex
from pyspark.sql import DataFrame

from bibloom.llm.common import map_batches

#: Words of one generation of a worker's memory; some 100 MB for both.
CACHE_WORDS = 150_000
#: The split of byte-level BPE, as its files leave it to the library.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEADING_SPACE = regex.compile(r"\p{White_Space}*")
#: Above every merge rank.
NEVER = 1 << 40


class Remembered(dict):
    """A bounded map from words to results; the least recently used half goes first."""

    def __init__(self, make, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: Latin-1's
    visible characters for themselves, the rest in order from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge(symbols: list[int], pairs: dict[int, int], merged: list[int]) -> list[int]:
    """Apply merges by rank, leftmost first among equals, until no pair of neighbours has one.

    ``pairs`` has the rank of a pair at ``left << 20 | right``, ``merged`` the symbol by rank.
    A queue entry is rank and place in one number; it is stale, and skipped, if the symbols now
    at that place have another rank or none.
    """
    n = len(symbols)
    rank_of = pairs.get
    queue = [r * n + i for i in range(n - 1) if (r := rank_of(symbols[i] << 20 | symbols[i + 1])) is not None]
    if not queue:
        return symbols
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapq.heapify(queue)
    while queue:
        rank, i = divmod(heapq.heappop(queue), n)
        j = after[i]
        if symbols[i] < 0 or j >= n or rank_of(symbols[i] << 20 | symbols[j]) != rank:
            continue
        new = merged[rank]
        symbols[i], symbols[j] = new, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of(new << 20 | symbols[k])) is not None:
                heapq.heappush(queue, r * n + i)
        h = before[i]
        if h >= 0 and (r := rank_of(symbols[h] << 20 | new)) is not None:
            heapq.heappush(queue, r * n + h)
    return [s for s in symbols if s >= 0]


class Vocabulary:
    """Tables of one tokenizer file (.json of the tokenizers library, BPE model)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = [self.ids[a + b] for a, b in parts]
        self.pairs = {self.ids[a] << 20 | self.ids[b]: rank for rank, (a, b) in enumerate(parts)}
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.lower, self.nfc = "Lowercase" in steps, "NFC" in steps
        split = next((p["pattern"]["Regex"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), BYTE_LEVEL_SPLIT)
        space = r"\p{White_Space}"
        self.split = regex.compile(split.replace(r"[^\s", f"[^{space}").replace(r"\s", space).replace(r"\S", r"\P{White_Space}"))
        #: the same split for ASCII texts, in the faster engine
        plain = split.replace(r"[^\s\p{L}\p{N}]", "[^\\sA-Za-z0-9]").replace(r"[\p{L}]", "[A-Za-z]").replace(r"[\p{N}]", "[0-9]")
        self.plain_split = re.compile(plain.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        symbols = byte_symbols()
        self.first = [self.ids[s] for s in symbols]
        self.last = [self.ids.get(s + self.suffix, self.ids[s]) for s in symbols]
        self.words = Remembered(self._encode_word)
        self.pieces = Remembered(self._prefix_counts, CACHE_WORDS)
        self.totals = Remembered(self._total, 2 * CACHE_WORDS)
        if not self.suffix:
            self._prepare_counts(symbols, parts)

    def _prepare_counts(self, symbols: list[str], parts: list[list[str]]) -> None:
        """Tables for counts at prefixes, for vocabularies without word ends."""
        codes = {ord(s): b for b, s in enumerate(symbols)}
        self.tokens = {bytes(codes[ord(c)] for c in s): i for s, i in self.ids.items() if all(ord(c) in codes for c in s)}
        self.longest = max(map(len, self.tokens))
        #: what a token begins with: its id if it is one itself, else -1
        self.starts = {t[:k]: -1 for t in self.tokens for k in range(1, len(t))} | self.tokens
        self.joins = Remembered(self._stay_apart, 400_000)
        self.whole = {i: merge([self.first[b] for b in t], self.pairs, self.merged) == [i] for t, i in self.tokens.items()}
        made = {new: (rank, self.ids[a], self.ids[b]) for rank, ((a, b), new) in reversed([*enumerate(zip(parts, self.merged, strict=True))])}
        #: of a token: the symbols at its right (left) edge as it is built, each with the rank of
        #: the merge that takes it in
        self.right_edge, self.left_edge = {}, {}
        for i in self.tokens.values():
            for edge, side in ((self.right_edge, 2), (self.left_edge, 1)):
                steps, at, taken = [], i, NEVER
                while True:
                    steps.append((at, taken))
                    if at not in made:
                        break
                    taken, at = made[at][0], made[at][side]
                edge[i] = steps[::-1]

    # ---- encoding and decoding

    def _encode_word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        symbols = [self.first[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return tuple(merge(symbols, self.pairs, self.merged))

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower() if self.lower else text
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        # character by character, so that a final sigma is no exception
        return text.replace("Σ", "σ").lower() if self.lower else text

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at special strings: (segment, None) or (special string, id)."""
        if self.specials is None or not self.specials.search(text):
            return [(text, None)]
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [(text[at : m.start()], None), (m[0], self.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]

    def cut(self, segment: str) -> list[str]:
        """The pieces of a segment without special strings, normalised already."""
        return (self.plain_split if segment.isascii() else self.split).findall(segment)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for segment, special in self.segments(text or ""):
            if special is not None:
                out.append(special)
            elif segment:
                words = self.words
                out.extend(chain.from_iterable([words[w] for w in self.cut(self.normalize(segment))]))
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, with a space between two, as a file without decoder asks."""
        return " ".join(map(self.strings.__getitem__, ids))

    # ---- counts at prefixes

    def _stay_apart(self, pair: int) -> bool:
        """Does encoding the joint bytes of two tokens give these two again?

        Both are built by merges of rising rank; at each time one symbol stands on either side
        of the border. They grow together if the pair there has a merge that comes before the
        merges that take these symbols into their own tokens.
        """
        left, right = iter(self.right_edge[pair >> 20]), iter(self.left_edge[pair & 0xFFFFF])
        (x, x_taken), (y, y_taken) = next(left), next(right)
        while True:
            across = self.pairs.get(x << 20 | y, NEVER)
            if across < x_taken and across <= y_taken and across != NEVER:
                return False
            if x_taken == y_taken == NEVER:
                return True
            if x_taken <= y_taken:
                x, x_taken = next(left)
            else:
                y, y_taken = next(right)

    def _prefix_counts(self, piece: str) -> tuple[int, ...]:
        """Tokens of each prefix of a piece, by code points, from 0 to all.

        The encoding of a prefix ends in exactly one token t such that t stays apart from the
        last token of what stands before it; so one pass with the last token of every prefix
        gives all the counts.
        """
        raw = piece.encode()
        n, token_at, joins = len(raw), self.starts.get, self.joins
        count, last = [0] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, more, far = last[start] << 20, count[start] + 1, min(n, start + self.longest)
            for end in range(start + 1, far + 1):
                token = token_at(raw[start:end])
                if token is None:  # no token begins with these bytes
                    break
                if token >= 0 and not count[end] and (joins[before | token] if start else self.whole[token]):
                    count[end], last[end] = more, token
        if len(piece) == n:
            return tuple(count)
        ends, at = [0], 0
        for c in piece:
            at += len(c.encode())
            ends.append(at)
        return tuple(count[e] for e in ends)

    def _total(self, piece: str) -> int:
        return self._prefix_counts(piece)[-1]

    def piece_totals(self, text: str) -> tuple[list[str], list[int]]:
        """Pieces of a whole text and the tokens of each."""
        pieces, totals = [], []
        for segment, special in self.segments(text):
            if special is not None:
                pieces.append(segment)
                totals.append(1)
            else:
                found = self.cut(segment)
                pieces += found
                totals += map(self.totals.__getitem__, found)
        return pieces, totals

    def prefix_counts(self, text: str | None) -> list[int]:
        """Tokens of text[:i] for every i from 0 to len(text), each as encoding that prefix gives.

        A prefix cuts only its last pieces otherwise than the text does: white space at its end
        is one piece, a cut contraction is an apostrophe and letters, a cut special string is
        ordinary text.
        """
        text = text or ""
        out, done = [0], 0  # done: tokens of the pieces before
        context, context_done = "", 0  # the last piece before, and the tokens before it
        for segment, special in self.segments(text):
            if special is not None:
                out += [context_done + self._plain_count(context + segment[:i]) for i in range(1, len(segment))]
                done += 1
                out.append(done)
                context, context_done = "", done
                continue
            run, run_done = "", 0  # white space up to here
            for piece in self.cut(segment):
                counts, base = self.pieces[piece], done
                done += counts[-1]
                spaces = LEADING_SPACE.match(piece).end()
                if spaces:
                    if not run:
                        run_done = base
                    run += piece[:spaces]
                    whole = self.pieces[run]
                    out += [run_done + c for c in whole[len(run) - spaces + 1 :]]
                if spaces < len(piece):
                    rest = counts[spaces + 1 :]
                    if piece[0] == "'" and len(piece) == 3 and piece[1:] in ("re", "ve", "ll"):
                        rest = (counts[1], counts[1] + self.pieces[piece[1]][-1], counts[3])
                    out += [base + c for c in rest]
                    run = ""
                    context, context_done = piece, base
                else:
                    context, context_done = run, run_done
        return out

    def _plain_count(self, text: str) -> int:
        return sum(self.pieces[p][-1] for p in self.cut(text))

    def fitting(self, text: str, pieces: list[str], totals: list[int], limit: int) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens.

        Prefixes are looked at from the last piece on that begins within the limit and that no
        white space, special string or part of one stands before: those in it count as they would
        from the start of the text, and what lies before is shorter.
        """
        if sum(totals) <= limit:
            return len(text)
        ends = list(accumulate(totals))
        # white space before the next word may make one piece less than here: look two on
        stop = bisect_right(ends, limit + 1) + 1
        k = min(bisect_right(ends, limit), len(pieces) - 1)
        while k and (pieces[k] in self.special or pieces[k - 1].isspace()):
            k -= 1
        low, low_done = sum(map(len, pieces[:k])), ends[k] - totals[k]
        at = low + sum(map(len, pieces[k:stop]))
        counts = self.prefix_counts(text[low:at])
        return low + max(i for i, c in enumerate(counts) if c <= limit - low_done)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(content: str) -> Vocabulary:
    """The tables of this content, built once in each Python process."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(content)
    return _loaded[key]


def _shared(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids array<int>, decoded string) of every row; null texts count as empty.

    Each row is taken by itself: repeated ids give repeated rows, a null id stays null, other
    columns are dropped, and an empty table gives an empty result. A text of any length is
    encoded whole.
    """
    shared = _shared(df, path)

    def start():
        v = vocabulary(shared.value)

        def rows(ids, texts):
            codes = [v.encode(t) for t in texts]
            return [ids, codes, [v.decode(c) for c in codes]]

        return rows

    kind = dict(df.dtypes)[id_col]
    return map_batches(df.select(id_col, text), start, f"`{id_col}` {kind}, ids array<int>, decoded string")


def encode_digest(df: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts and hashes of ``encode`` without moving its arrays out of the workers:
    id_col, n_tokens, ids_sha256 (little-endian unsigned 32-bit), decoded_sha256 (UTF-8)."""
    shared = _shared(df, path)

    def start():
        v = vocabulary(shared.value)

        def rows(ids, texts):
            n, hashes, decoded = [], [], []
            for t in texts:
                codes = v.encode(t)
                packed = array("I", codes)
                n.append(len(codes))
                hashes.append(hashlib.sha256(packed.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(v.decode(codes).encode()).hexdigest())
            return [ids, n, hashes, decoded]

        return rows

    kind = dict(df.dtypes)[id_col]
    return map_batches(
        df.select(id_col, text), start, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def token_counts(df: DataFrame, path: str, limit: int = 1024, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit, fit_chars of every row.

    fit_chars is the length in code points of the longest prefix of at most ``limit`` tokens.
    Null texts count as empty. Every row is taken by itself, whatever its length; repeated
    rows repeat, other columns are dropped, an empty table gives an empty result.
    """
    shared = _shared(df, path)

    def start():
        v = vocabulary(shared.value)

        def rows(ids, texts):
            n_bytes, n, over, fit = [], [], [], []
            for t in texts:
                t = t or ""
                pieces, totals = v.piece_totals(t)
                n_bytes.append(len(t.encode()))
                n.append(total := sum(totals))
                over.append(total > limit)
                fit.append(v.fitting(t, pieces, totals, limit))
            return [ids, n_bytes, n, over, fit]

        return rows

    kind = dict(df.dtypes)[id_col]
    return map_batches(
        df.select(id_col, text), start, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    )


def prefix_counts(df: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, counts array<int>): counts[i] is the number of tokens of the first i code points,
    for i from 0 to the length of the text. Rows are treated as by ``token_counts``."""
    shared = _shared(df, path)

    def start():
        v = vocabulary(shared.value)
        return lambda ids, texts: [ids, [v.prefix_counts(t) for t in texts]]

    kind = dict(df.dtypes)[id_col]
    return map_batches(df.select(id_col, text), start, f"`{id_col}` {kind}, counts array<int>")
