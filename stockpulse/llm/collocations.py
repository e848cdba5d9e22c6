"""Collocations by Toivonen's sampling method: frequent phrases, counted exactly.

A seeded sample of the documents proposes phrases: those frequent in it at a lowered
threshold. One full pass counts every word, every proposed phrase and its negative
border: the phrases whose two longest parts (all words but the last, all but the first)
are both proposed. A border phrase that turns out frequent may have frequent
extensions that were not counted; then the known frequent phrases become the proposal and a
further pass counts what the larger proposal and border add, until no border fails.
Every frequent phrase has frequent parts, so nothing is missed; a phrase is
counted in exactly one pass, over all documents, so all counts are exact.

The proposals are sent to the tasks as Bloom filters of a bounded size, one set per pass. A
false positive counts a phrase that need not have been counted; a proposal is never missed.
In the full pass phrases are numbers of word numbers inside a task (no hashing of phrases), and
counts are combined there, once per `FLUSH_WORDS` words, before the shuffle, which carries
only words and phrases with proposed parts. The expansion passes look for words and phrases that
the last filter added, by hash, and read the words themselves only around those.

Texts: A-Z lower-cased, split at `.,;:!?` and line breaks (0x0A-0x0D) into pieces, those at space
and tab into words. Score of a phrase of count a cut into parts of counts l and r:
floor(1000000 a a / (l r)), the least cut counts, equal ones by the shortest first part.

Defined results: null and empty texts have no words; a null language is `und`; repeated
documents count each; very long texts are read in slices with phrases across the slices;
ties go by count, then by phrase; an empty table gives an empty result. Counts are exact
below 10**15. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockpulse.llm import bytescan as bs
from stockpulse.llm import tokens
from stockpulse.llm.scratch import shuffle_partitions, written

MIN_COUNT = 10
MAX_WORDS = 3
SAMPLE_RATE = 0.25
SLACK = 0.8                # lowered threshold: this share of the count expected in the sample
SHARE = 50                 # percent of a phrase's count that a longer one needs to replace it
TOP = 2000
SEED = 12
FLUSH_WORDS = 1_000_000
FILTER_BITS = (1 << 20, 1 << 28)    # least and largest Bloom filter
FILTER_PROBES = 4
OUT_ROWS = 200_000
HELD_PHRASES = 200_000       # distinct phrases an expansion pass holds before it sends them

BREAK = b"."
PIECE_TABLE = tokens.table(b".,;:!?\x0a\x0b\x0c\x0d", BREAK, (b"\t", b" "))


INSIDE = np.ones(256, dtype=bool)      # bytes of words
INSIDE[list(b" \t" + b".,;:!?\x0a\x0b\x0c\x0d")] = False
ENDS_PIECE = ~INSIDE
ENDS_PIECE[list(b" \t")] = False


SKIPPED, WORD = rb"[ \t.,;:!?\x0a-\x0d]*", rb"[^ \t.,;:!?\x0a-\x0d]+"


def seeds(langs: list[str]) -> np.ndarray:
    return bs.mix(np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) + 1 for x in langs], dtype=np.uint64))


def word_hashes(words: list[bytes], seed: np.ndarray) -> np.ndarray:
    size = np.array([len(w) for w in words], dtype=np.int64)
    end = np.cumsum(size)
    return bs.mix(bs.word_hashes(np.frombuffer(b"".join(words), np.uint8), end - size, end) ^ seed)


def extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of its words but the last and the last word's."""
    return bs.mix(h * np.uint64(bs.BASE) + word)


class Bloom:
    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits          # 64-bit words, a power of two of them

    @staticmethod
    def place(h: np.ndarray, probe: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Word index and mask of one probe of every hash."""
        at = h if probe == 0 else h + (bs.mix(h) | np.uint64(1)) * np.uint64(probe)
        return ((at >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=bool)
        left = np.arange(len(h))
        for probe in range(FILTER_PROBES):
            i, mask = self.place(h[left], probe, len(self.bits))
            left = left[(self.bits[i] & mask) != 0]
        out[left] = True
        return out


def any_has(filters: list[Bloom], h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), dtype=bool)
    for f in filters:
        rest = np.flatnonzero(~out)
        out[rest] = f.has(h[rest])
    return out


def proposed_at(filters: list[list[Bloom]], hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Whether the phrases at these places are proposed: they and all their parts are in the filters
    of their lengths. `hashes` holds those of the phrases of 1 word, 2 words and so on up to
    their length. (The parts are asked too, as a filter may have a phrase that no one put in:
    with a part unproposed, the passes so far have not counted around it.)"""
    out = any_has(filters[len(hashes) - 1], hashes[-1][at])
    if len(hashes) > 1:
        for j in (0, 1):
            rest = np.flatnonzero(out)
            out[rest] = proposed_at(filters, hashes[:-1], at[rest] + j)
    return out


class _Buffer:
    """Word numbers of the documents of one language, 0 between pieces."""

    def __init__(self) -> None:
        self.number = {BREAK: 0}
        self.words = array("q")

    def add(self, text: str) -> None:
        number = self.number
        for part in tokens.parts(text.encode("utf-8", "surrogatepass").translate(PIECE_TABLE), b" " + BREAK):
            self.words.extend([number.setdefault(w, len(number)) for w in part.replace(BREAK, b" . ").split()])
        self.words.append(0)

    def counts(self, lang: str, longest: int, proposed: list[Bloom] | None):
        """(keys, counts) of the words, of the phrases with proposed parts, and under the empty
        phrase of the number of words. A key is the language, a tab and the phrase."""
        a = np.frombuffer(self.words, dtype=np.int64)
        prefix = lang.encode("utf-8", "surrogatepass") + b"\t"
        words = list(self.number)
        texts = pa.array(words, pa.binary())
        c = np.bincount(a, minlength=len(words))
        yield pa.array([prefix], pa.binary()), np.array([c[1:].sum()])
        phrase = pa.array([prefix + w for w in words], pa.binary())
        yield phrase[1:], c[1:]
        wh = h = word_hashes(words, seeds([lang])) if proposed else None
        at = np.where(a > 0, a, -1)        # the phrase of the length before that starts here
        for length in range(2, longest + 1):
            if proposed:
                ok = np.append(proposed[length - 2].has(h), False)    # the last place: none
                at = np.where(ok[at], at, -1)
            both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
            if not len(both):
                return
            key, last = at[both] * len(words) + a[both + length - 1], length == longest
            if last:
                key, count = np.unique(key, return_counts=True)
            else:
                key, inv, count = np.unique(key, return_inverse=True, return_counts=True)
            head, tail = key // len(words), key % len(words)
            phrase = pc.binary_join_element_wise(phrase.take(pa.array(head)), texts.take(pa.array(tail)), b" ")
            yield phrase, count
            if not last:
                h = extended(h[head], wh[tail]) if proposed else None
                at = np.full(len(a), -1, dtype=np.int64)
                at[both] = inv


def _count(longest: int, shared):
    """Partial counts (key, f) of all words and of the phrases whose parts are proposed (all
    phrases without a proposal)."""
    def run(batches):
        proposed = shared.value if shared is not None else None
        held: dict[str, _Buffer] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    buf = held.setdefault(lang, _Buffer())
                    was = len(buf.words)
                    buf.add(text)
                    size += len(buf.words) - was
                if size >= FLUSH_WORDS:
                    yield from _emit(held, longest, proposed)
                    held, size = {}, 0
        yield from _emit(held, longest, proposed)
    return run


def _emit(held, longest, proposed):
    for lang, buf in held.items():
        for keys, count in buf.counts(lang, longest, proposed):
            for i in range(0, len(keys), OUT_ROWS):
                yield _rows(keys.slice(i, OUT_ROWS), count[i:i + OUT_ROWS])


def _rows(keys, count) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(np.asarray(count, dtype=np.int64))], ["key", "f"])


def _expand(longest: int, shared):
    """Partial counts of the phrases that the last proposal adds: both longest parts proposed,
    not both before."""
    def run(batches):
        before, added = shared.value         # per length: earlier filters, the last one
        now = [[*f, new] for f, new in zip(before, added)]
        held: Counter = Counter()
        for batch in batches:
            for here, texts, own in _sliced(batch, longest):
                data, offsets = bs.text_column(texts)
                start, end, of = bs.words(data, offsets, INSIDE)
                if not len(start):
                    continue
                lower = bs.LOWER[data]
                doc = np.repeat(np.arange(len(here)), np.diff(of))
                mine = start - offsets[doc] < own[doc]
                piece = np.cumsum(ENDS_PIECE[data])[start] + doc        # grows at each end of a piece
                h = wh = bs.mix(bs.word_hashes(lower, start, end) ^ seeds(here)[doc])
                hashes, around = [], np.zeros(0, dtype=np.int64)
                raw = None
                for length in range(2, longest + 1):
                    n = len(start) - length + 1
                    if n <= 0:
                        break
                    hashes.append(h)
                    # positions of parts (one word shorter) that are new, in the last filter or, if in an
                    # earlier one, with a new part of their own, and the phrases around them
                    new = np.concatenate([np.flatnonzero(added[length - 2].has(h)),
                                          around[any_has(before[length - 2], h[around])]])
                    at = np.unique(np.concatenate([new, new - 1]))
                    at = at[(at >= 0) & (at < n)]
                    at = at[(piece[at] == piece[at + length - 1]) & (doc[at] == doc[at + length - 1])]
                    for j in (0, 1):
                        at = at[proposed_at(now, hashes, at + j)]
                    around = at = at[~(proposed_at(before, hashes, at) & proposed_at(before, hashes, at + 1))]
                    at = at[mine[at]]
                    if len(at) and raw is None:
                        raw = lower.tobytes()
                    for i in at.tolist():
                        words = [raw[x:y] for x, y in zip(start[i:i + length].tolist(), end[i:i + length].tolist())]
                        held[here[doc[i]], b" ".join(words)] += 1
                    h = extended(h[:n], wh[length - 1:])
            if len(held) > HELD_PHRASES:
                yield _held(held)
                held.clear()
        yield _held(held)
    return run


def _sliced(batch, longest: int):
    """(languages, texts, bytes of each text in which its phrases start): the rows in slices. A text
    longer than a slice comes as parts with the words behind them that their last phrases need."""
    langs, col = batch.column(0).to_pylist(), batch.column(1)
    if max((len(t) for t in col.to_pylist() if t), default=0) <= bs.SLICE_BYTES // 4:
        first = 0
        for part in bs.slices(batch, "text"):
            texts = part.column("text")
            yield langs[first:first + part.num_rows], texts, np.diff(bs.text_column(texts)[1])
            first += part.num_rows
        return
    behind = re.compile(b"(?:" + SKIPPED + WORD + b"){0,%d}" % (longest - 1))
    for lang, text in zip(langs, col.to_pylist()):
        data, at = (text or "").encode("utf-8", "surrogatepass"), 0
        for part in tokens.parts(data, b" \t\n.,", bs.SLICE_BYTES):
            to = behind.match(data, at + len(part)).end()
            yield [lang], pa.array([data[at:to]], pa.binary()).view(pa.string()), np.array([len(part)])
            at += len(part)


def _held(held) -> pa.RecordBatch:
    return _rows(pa.array([lang.encode("utf-8", "surrogatepass") + b"\t" + p for lang, p in held], pa.binary()),
                 np.fromiter(held.values(), dtype=np.int64, count=len(held)))


def phrase_hashes(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """Hashes of the phrases (lang, phrase) of one length."""
    words = [w for p in batch.column("phrase").to_pylist() for w in p.encode("utf-8", "surrogatepass").split(b" ")]
    h = word_hashes(words, np.repeat(seeds(batch.column("lang").to_pylist()), length)).reshape(-1, length)
    out = h[:, 0]
    for j in range(1, length):
        out = extended(out, h[:, j])
    return out


def _unproposed(length: int, shared):
    """The phrases of that length that no filter has."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(~any_has(shared.value[length - 1], phrase_hashes(batch, length))))
    return run


def _places(length: int, words: int):
    """Filter words (index, bits) of phrases, combined per batch."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            h = phrase_hashes(batch, length)
            i, mask = (np.concatenate(x) for x in zip(*(Bloom.place(h, p, words) for p in range(FILTER_PROBES))))
            order = np.argsort(i)
            u, first = np.unique(i[order], return_index=True)
            bits = np.bitwise_or.reduceat(mask[order], first)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(bits.view(np.int64))], ["i", "bits"])
    return run


def bloom(phrases: DataFrame, length: int, filter_bits: tuple[int, int]) -> tuple[Bloom, int]:
    """(filter over the phrases (lang, phrase) of one length, how many they are). The filter has
    16 to 32 bits a phrase within the limits; its words are all that reaches the driver."""
    count = phrases.count()
    words = min(max(1 << (16 * count).bit_length(), filter_bits[0]), filter_bits[1]) >> 6
    bits = np.zeros(words, dtype=np.uint64)
    if count:
        got = (phrases.select("lang", "phrase").mapInArrow(_places(length, words), "i long, bits long")
               .groupBy("i").agg(F.bit_or("bits").alias("bits")).toArrow())
        bits[np.asarray(got.column("i").combine_chunks())] = np.asarray(got.column("bits").combine_chunks()).view(np.uint64)
    return Bloom(bits), count


def _summed(partial: DataFrame, least: int, name: str) -> DataFrame:
    """(lang, m, phrase, f) with f >= least, and the rows m = 0. The tasks have combined their
    counts; another combination in front of the shuffle would find few equal phrases."""
    phrase = F.substring_index("key", "\t", -1)
    return written(
        partial.repartition("key").groupBy("key").agg(F.sum("f").alias("f"))
        .filter((F.col("f") >= least) | F.endswith("key", F.lit("\t")))
        .select(F.expr("left(key, char_length(key) - char_length(substring_index(key, '\t', -1)) - 1)").alias("lang"),
                F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("m"), phrase.alias("phrase"), "f"), name)


def frequent_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, sample_rate: float = SAMPLE_RATE,
                     slack: float = SLACK, filter_bits: tuple[int, int] = FILTER_BITS) -> tuple[DataFrame, int]:
    """((lang, m, phrase, f), passes): all phrases of m = 1 to max_words words with f >= min_count,
    and per language a row m = 0 with the number of its words. `passes` counts the full ones."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    cut = round(sample_rate * (1 << 31))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 31)) < cut).select("lang", "text")
    rows = rows.select("lang", "text")
    sc, lengths = docs.sparkSession.sparkContext, range(1, max_words)
    least = max(1, int(sample_rate * min_count * slack))
    proposed = _summed(sample.mapInArrow(_count(max_words - 1, None), "key string, f long"), least, "phrases-sample")
    filters = [[bloom(proposed.filter(F.col("m") == m), m, filter_bits)[0]] for m in lengths]
    shared = sc.broadcast([f[0] for f in filters])
    known = found = _summed(rows.mapInArrow(_count(max_words, shared), "key string, f long"), min_count, "phrases-pass1")
    passes = 1
    while True:
        # the border holds if all that was found frequent had been proposed
        so_far = sc.broadcast(filters)
        failed = [bloom(found.filter(F.col("m") == m).select("lang", "phrase")
                        .mapInArrow(_unproposed(m, so_far), "lang string, phrase string"), m, filter_bits) for m in lengths]
        if not any(count for _, count in failed):
            return known, passes
        passes += 1
        added = sc.broadcast((filters, [f for f, _ in failed]))
        found = _summed(rows.mapInArrow(_expand(max_words, added), "key string, f long"), min_count, f"phrases-pass{passes}")
        known = known.unionByName(found)
        filters = [f + [new] for f, (new, _) in zip(filters, failed)]


def scored(known: DataFrame) -> DataFrame:
    """(lang, m, phrase, a, l, r, score) of all phrases of two words or more: the least-scoring cut."""
    cands = known.filter("m >= 2").select("lang", "m", "phrase", F.col("f").alias("a"))
    cuts = (cands.withColumn("w", F.split("phrase", " "))
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
            .select("lang", "m", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                    F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("rest")))
    part = known.filter("m >= 1").select("lang", "phrase", "f")
    both = (cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)))"
                   " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))").cast("long")
    return (both.withColumn("score", score).groupBy("lang", "m", "phrase", "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "m", "phrase", "a", "cut.l", "cut.r", "cut.score"))


def without_parts(cands: DataFrame, max_words: int, share: int) -> DataFrame:
    """Drops a phrase that a longer one contains which has `share` percent of its count or more."""
    out = cands
    if max_words > 2:
        inner = (cands.filter("m >= 3").withColumn("w", F.split("phrase", " "))
                 .withColumn("n", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
                 .withColumn("s", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("n") + 1)))
                 .select("lang", F.array_join(F.slice("w", F.col("s"), F.col("n")), " ").alias("phrase"), "a")
                 .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
        out = (cands.join(inner, ["lang", "phrase"], "left")
               .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer"))
    return out


def mine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
         min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, share: int = SHARE,
         sample_rate: float = SAMPLE_RATE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` collocations."""
    known, _ = frequent_phrases(docs, id_col, text_col, lang_col, min_count, max_words, sample_rate)
    cands = written(scored(known), "phrases-scored")
    kept = without_parts(cands, max_words, share)
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # first in parts of a language, then among the parts' first
    salt = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
    parts = (kept.withColumn("salt", salt)
             .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best)))
             .filter(F.col("rank") <= top))
    ranked = (parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
              .filter(F.col("rank") <= top))
    n = known.filter("m = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
