"""Encoding and decoding with a merge-type piece vocabulary.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they would
form, best first and leftmost among equals. The best pair is merged, its two new neighbours enter
the agenda, and pairs whose symbols have changed meanwhile are skipped when they come up. Symbols
that no piece covers become byte pieces. No piece reaches over the spans between spaces, so the
agendas of many short spans are worked off side by side and spans that come back are looked up. A long
span, such as a text without spaces, has an agenda of its own, in which all pairs of one score come up together. In every
Arrow batch, all new spans and some whole texts are compared with the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplight.llm.common import map_batches, table, text_slices
from shoplight.session import prepare

SPACE_MARK = "▁"
# Spans whose ids one task keeps; beyond that it starts over.
CACHED_SPANS, CACHED_BYTES = 1_000_000, 48 << 20
# Every span that a task meets is compared with the library; so is every such text of an Arrow batch as a whole.
WHOLE_CHECKS = 16
NO_PAIR = np.iinfo(np.int64).max
# Symbols from which a span has its own agenda.
LONG_SPAN = 256


class PieceEncoder:
    """The vocabulary of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.vocab_size()
        scores: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        self.symbols: dict[str, int] = {}  # pieces by id; then, as they come, symbols that have no piece
        self.pieces = size
        for i in range(size):
            piece = library.id_to_piece(i)
            if library.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            if library.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            if library.is_byte(i) or library.is_control(i) or library.is_unknown(i):
                self.symbols[f"\0{i}"] = i  # no symbol of a text has this name
            else:
                scores[piece] = (library.get_score(i), i)
                self.symbols[piece] = i
        if len(self.bytes) != 256:
            raise ValueError("only vocabularies with byte pieces are supported")
        self.decimal = [b"%d," % i for i in range(size)]
        self.pair_table(scores)
        long = [p for p in scores if len(p) > 1]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in long):
            raise ValueError("pieces with inner spaces are not supported")
        # No piece reaches over a span: a span is a run of space marks and symbols that occur in longer pieces, or one other symbol.
        inner = "".join(sorted({re.escape(c) for p in long for c in p if c != SPACE_MARK}))
        self.span = re.compile(f"{SPACE_MARK}*[{inner}]+|{SPACE_MARK}+|.", re.DOTALL)
        self.forget()

    def pair_table(self, scores: dict[str, tuple[float, int]]) -> None:
        """Every pair of symbols that forms a piece, by key, with its place in the order of scores."""
        order = {score: place for place, score in enumerate(sorted({s for s, _ in scores.values()}, reverse=True))}
        rows = sorted((self.symbols[p[:k]] << 32 | self.symbols[p[k:]], order[score], i)
                      for p, (score, i) in scores.items() for k in range(1, len(p)) if p[:k] in scores and p[k:] in scores)
        self.pairs: dict[int, tuple[int, int]] | None = None  # the same as a dictionary, once it is needed
        keys, ranks, made = zip(*rows)
        self.pair_keys, self.pair_ranks, self.pair_pieces = (np.array(x, dtype=np.int64) for x in (keys, ranks, made))

    def forget(self) -> None:
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.size = 0

    def agenda_ids(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many spans, side by side, and where each span's ids begin.

        In each turn the best adjacent pair of every span is merged, and the pairs beside it get
        new places in the agenda. A span is done when no pair of it is a piece.
        """
        long = [i for i, s in enumerate(spans) if len(s) >= LONG_SPAN]
        side_by_side = [s if len(s) < LONG_SPAN else "" for s in spans]
        symbols = np.array([self.symbols.setdefault(c, len(self.symbols)) for c in "".join(side_by_side)], dtype=np.int64)
        owner = np.repeat(np.arange(len(spans)), [len(s) for s in side_by_side])
        done_symbols, done_owner = [], []
        rank, made = self.pair(symbols, owner)
        while len(symbols):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            # Spans without a pair are finished and leave the agenda.
            counts = np.diff(first, append=len(owner))
            live = np.repeat(best < NO_PAIR, counts)
            done_symbols.append(symbols[~live])
            done_owner.append(owner[~live])
            best_here = np.repeat(best, counts)[live]
            symbols, owner, rank, made = symbols[live], owner[live], rank[live], made[live]
            if not len(symbols):
                break
            hits = np.flatnonzero(rank == best_here)
            left = hits[np.flatnonzero(np.diff(owner[hits], prepend=-1))]  # the leftmost of each span
            symbols[left] = made[left]
            keep = np.ones(len(symbols), dtype=bool)
            keep[left + 1] = False
            left = left - np.arange(len(left))  # where the merged symbols are once the others are out
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            changed = np.concatenate([left, left[left > 0] - 1])
            rank[changed], made[changed] = self.pair(symbols, owner, changed)
        if long:
            long_symbols, place = self.long_spans([spans[i] for i in long])
            done_symbols.append(long_symbols)
            done_owner.append(np.array(long)[place])
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        symbols, owner = symbols[order], owner[order]
        if len(missing := np.flatnonzero(symbols >= self.pieces)):
            symbols, owner = self.as_bytes(symbols, owner, missing)
        return symbols.astype(np.int32), np.searchsorted(owner, np.arange(len(spans) + 1))

    def long_spans(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of long spans once no pair of them is a piece, and the span of each.

        The agenda is a heap of scores with the places of their pairs. All pairs of the best score are merged at
        once, from the left; that is what one merge after another does, unless a new pair has a better
        score than the one at hand. Then the rest goes on with single merges.
        """
        symbol = np.array([self.symbols.setdefault(c, len(self.symbols)) for c in "".join(spans)], dtype=np.int64)
        sizes = np.array([len(s) for s in spans])
        n, ends = len(symbol), np.cumsum(sizes)
        owner = np.repeat(np.arange(len(spans)), sizes)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1], before[ends - sizes] = n, -1
        alive = np.ones(n, dtype=bool)
        rank, made = np.full(n, NO_PAIR), np.zeros(n, dtype=np.int64)
        agenda: list[int] = []
        places: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray) -> int:
            """Put the pairs that begin at these places on the agenda; their best score."""
            rank[at] = NO_PAIR
            at = at[following[at] < n]
            rank[at], made[at] = self.rated(symbol[at], symbol[following[at]])
            at = at[rank[at] < NO_PAIR]
            if not len(at):
                return NO_PAIR
            at = at[np.argsort(rank[at], kind="stable")]
            first = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for some in np.split(at, first[1:]):
                r = int(rank[some[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(agenda, r)
                places[r].append(some)
            return int(rank[at[0]])

        enter(np.arange(n))
        while agenda:
            best = heapq.heappop(agenda)
            at = np.unique(np.concatenate(places.pop(best)))
            at = at[rank[at] == best]
            # Of pairs that overlap one after another, as in a run of one symbol, every second is merged.
            run = np.flatnonzero(np.r_[True, following[at[:-1]] != at[1:]]) if len(at) else at
            place = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            at = at[place % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            symbol[at] = made[at]
            rank[gone], alive[gone] = NO_PAIR, False
            following[at] = following[gone]
            inner = following[at] < n
            before[following[at[inner]]] = at[inner]
            touched = np.concatenate([at, before[at][before[at] >= 0]])
            if enter(np.unique(touched)) < best:
                symbol, alive = self.one_by_one(symbol, following, before, rank, alive)
                break
        return symbol[alive], owner[alive]

    def one_by_one(self, symbol: np.ndarray, following: np.ndarray, before: np.ndarray, rank: np.ndarray,
                   alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single merges from a heap of (score, place), from any state of long spans; the symbols and which of them are left."""
        n = len(symbol)
        if self.pairs is None:
            self.pairs = dict(zip(self.pair_keys.tolist(), zip(self.pair_ranks.tolist(), self.pair_pieces.tolist())))
        agenda = [(r, i) for r, i in zip(rank.tolist(), range(n)) if r < NO_PAIR]
        heapq.heapify(agenda)
        pairs, none = self.pairs, (NO_PAIR, -1)
        symbols, after, ahead, ranks, left_over = symbol.tolist(), following.tolist(), before.tolist(), rank.tolist(), alive.tolist()
        while agenda:
            best, at = heapq.heappop(agenda)
            if ranks[at] != best:
                continue
            gone = after[at]
            symbols[at] = pairs[symbols[at] << 32 | symbols[gone]][1]
            ranks[gone], left_over[gone], end = NO_PAIR, False, after[gone]
            after[at] = end
            ranks[at] = NO_PAIR
            if end < n:
                ahead[end] = at
                ranks[at] = pairs.get(symbols[at] << 32 | symbols[end], none)[0]
                if ranks[at] < NO_PAIR:
                    heapq.heappush(agenda, (ranks[at], at))
            left = ahead[at]
            if left >= 0:
                ranks[left] = pairs.get(symbols[left] << 32 | symbols[at], none)[0]
                if ranks[left] < NO_PAIR:
                    heapq.heappush(agenda, (ranks[left], left))
        return np.array(symbols, dtype=np.int64), np.array(left_over)

    def rated(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in the order of scores and the pieces of pairs of symbols."""
        key = left << 32 | right
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[found] == key, self.pair_ranks[found], NO_PAIR), self.pair_pieces[found]

    def pair(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The place in the agenda and the piece of each symbol (or those at ``at``) with the next of its span."""
        at = np.arange(len(symbols)) if at is None else at
        following = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] << 32 | symbols[following]
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        known = (self.pair_keys[found] == key) & (owner[at] == owner[following]) & (at != following)
        return np.where(known, self.pair_ranks[found], NO_PAIR), self.pair_pieces[found]

    def as_bytes(self, symbols: np.ndarray, owner: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece as the pieces of their UTF-8 bytes."""
        names = list(self.symbols)
        raw = {s: [self.bytes[b] for b in names[s].encode()] for s in set(symbols[missing].tolist())}
        each = np.ones(len(symbols), dtype=np.int64)
        each[missing] = [len(raw[s]) for s in symbols[missing].tolist()]
        wide, wide_owner = np.repeat(symbols, each), np.repeat(owner, each)
        wide[wide >= self.pieces] = [i for s in symbols[missing].tolist() for i in raw[s]]
        return wide, wide_owner

    def learn(self, spans: list[str]) -> None:
        """Keep the ids of spans, and compare them with the library's."""
        ids, starts = self.agenda_ids(spans)
        # The library puts a space mark before each text; spans without one follow a line break, which no piece holds.
        marked = [s.startswith(SPACE_MARK) for s in spans]
        asked = [s.replace(SPACE_MARK, " ")[1:] if m else "\n" + s for s, m in zip(spans, marked)]
        theirs = self.library.encode(asked, num_threads=1)
        raw, decimal = ids.tobytes(), self.decimal
        for i, (span, m, their) in enumerate(zip(spans, marked, theirs)):
            own = ids[starts[i] : starts[i + 1]].tolist()
            if own != (their if m or not span else their[2:]):
                if span != SPACE_MARK:  # alone, it is the library's empty text
                    raise ValueError(f"ids differ from the library's for {span!r}")
            self.known[span] = (raw[4 * starts[i] : 4 * starts[i + 1]], b"".join([decimal[k] for k in own]))
            self.size += 9 * len(own) + len(span)
        if len(self.symbols) > self.pieces + 100_000:
            self.symbols = dict(list(self.symbols.items())[: self.pieces])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """The ids of each text, and their decimal forms with a comma after each."""
        split = [self.span.findall(SPACE_MARK + t.replace(" ", SPACE_MARK)) if t else [] for t in texts]
        known = self.known
        if len(known) > CACHED_SPANS or self.size > CACHED_BYTES:
            self.forget()
            known = self.known
        if new := set().union(*split).difference(known):
            self.learn(list(new))
        results = []
        for spans in split:
            found = [known[s] for s in spans]
            results.append((np.frombuffer(b"".join([f[0] for f in found]), dtype=np.int32), b"".join([f[1] for f in found])))
        return results

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())

    def check(self, texts: list[str], ids: list[np.ndarray]) -> None:
        """Compare whole texts with the library; a difference ends the job."""
        for text, own, theirs in zip(texts, ids, self.library.encode(texts, num_threads=1)):
            if not np.array_equal(own, np.array(theirs, dtype=np.int32)):
                raise ValueError(f"ids differ from the library's for a text that starts with {text[:80]!r}")


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoded(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", with_values: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; with ``with_values`` also ids and decoded.

    A null text is read as empty and has no ids. Repeated rows give repeated results, a null id
    stays null, an empty table gives an empty table, other columns are not read. Texts of any
    length are encoded whole.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_values:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model)
        for batch in batches:
            for keys, raw in text_slices(batch, "doc_id", "text", 1 << 20):
                texts = [t.decode("utf-8", "replace") for t in raw]
                found = pieces.encode(texts)
                pieces.check(texts[::WHOLE_CHECKS], [ids for ids, _ in found[::WHOLE_CHECKS]])
                decoded = [pieces.decode(ids) for ids, _ in found]
                columns = {
                    "doc_id": pa.array(keys, pa.int64()),
                    "n_tokens": pa.array([len(ids) for ids, _ in found], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(decimal[:-1]).hexdigest() for _, decimal in found]),
                    "decoded_sha256": pa.array([hashlib.sha256(d.encode("utf-8", "replace")).hexdigest() for d in decoded]),
                }
                if with_values:
                    columns["ids"] = pa.array([ids.tolist() for ids, _ in found], pa.list_(pa.int32()))
                    columns["decoded"] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(chosen, run, schema)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every document's ids and decoded text."""
    return encoded(table(prepare(spark), sf_dir, "documents"), model_path())
