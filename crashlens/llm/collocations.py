"""Collocations of one to four words by Toivonen's sampling algorithm (operator 13).

1. A sample of the documents is mined level by level at a lowered support. Its phrases are the
   proposal.
2. One pass over all documents counts exactly every phrase of the proposal and of its negative
   border. A phrase belongs to that set if its words without the last one and its words without
   the first one are both proposed; every single word does.
3. A border phrase that reaches the support is a failure of the proposal: it is added, and a
   further pass counts what the larger proposal has in addition. Passes go on until no new
   phrase is found. Then every phrase with the support has been counted, whatever the sample.

The proposal reaches the tasks as a bit filter of bounded size (``MAX_BITS``). A filter may let
through phrases that are not proposed; they are counted like the others and dropped if they are
rare, so its size changes the work and never the result. Nothing is counted by a hash: within a
task words are numbers and phrases pairs of numbers, or, in the further passes, which count few
phrases, the phrases themselves. Rows for the shuffle are sums over about a million words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.common import Staging, batch_of, python_tasks
from crashlens.llm.minhash_dedup import mix
from crashlens.llm.words import Numbers, byte_map, numbered, raw_texts, slices

LONGEST = 4                       # words in a phrase
SAMPLE, LOWERED = 8, 2            # one document in 8; the support within the sample
CHUNK = 1_000_000                 # words counted at a time
BLOCK_BYTES = 1 << 20             # text hashed at a time
VOCABULARY = 200_000              # words numbered at a time
ROWS = 20_000                     # rows handed to Spark at a time
MIN_BITS, MAX_BITS = 1 << 20, 1 << 30
BITS_PER_PHRASE = 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)

# Fixed values of the contract: what ends a piece, and the language of rows without one.
BREAKS = b".,;:!?\n\x0b\x0c\r"
UNDETERMINED = "und"
_BYTES = byte_map(b"\t", BREAKS)
_END = b"\xff"                    # no byte of a UTF-8 text
_BLANK, _NOTHING = (pa.scalar(x, pa.large_binary()) for x in (b" ", b""))


class Filter:
    """A bit filter over 64-bit phrase hashes: two bits a phrase."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in (h & self.mask, (h >> np.uint64(32)) & self.mask):
            at = at.astype(np.int64)
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


_RADIX, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The powers of the radix and of its inverse modulo 2 ** 64, for ``n`` places at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]).cumprod() for x in (_RADIX, _INVERSE)]
    return _POWERS


def hashed_words(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (the bytes as digits of a number modulo 2 ** 64, then mixed), start, end and piece
    of every word of a translated text, without a Python object for each."""
    a = np.frombuffer(buf, np.uint8)
    word = np.zeros(len(a) + 2, bool)
    word[1:-1] = (a != 0x20) & (a != 0x0A)
    edge = np.diff(word.view(np.int8))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    power, inverse = _powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[:len(a)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start])
    return h, start, end, np.searchsorted(np.nonzero(a == 0x0A)[0], start)


def language_seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


class Counter:
    """Counts the phrases of a stream of words, in blocks of ``CHUNK`` words."""

    def __init__(self, new: Filter | None, old: Filter | None, first: bool):
        self.new, self.old, self.first = new, old, first
        self.clear()

    def clear(self):
        self.by_lang: dict[str, Numbers] = {}
        self.base: list[tuple[str, bytes]] = [("", b"")]  # number -> language and word
        self.hashes = np.zeros(1, np.uint64)
        self.spelled = None       # the columns of all_words

    def renumber(self, w: np.ndarray) -> np.ndarray:
        """Forget all words but those of ``w``, and give these new numbers."""
        base = self.base
        self.clear()
        left = []
        for i in w.tolist():
            lang, word = base[i]
            if i and lang not in self.by_lang:
                self.by_lang[lang] = _Words(self, lang)
            left.append(self.by_lang[lang][word] if i else 0)
        return np.array(left, np.int64)

    def read(self, lang: str, raw: bytes) -> Iterator[np.ndarray]:
        """The words of a text as numbers; 0 ends a piece, and the text."""
        numbers = self.by_lang.get(lang)
        if numbers is None:
            numbers = self.by_lang[lang] = _Words(self, lang)
        for s in slices(raw.translate(_BYTES)):
            yield numbered(s.replace(b"\n", b" \xff ").split(), numbers)
        yield np.zeros(1, np.int64)

    def all_hashes(self) -> np.ndarray:
        fresh = self.base[len(self.hashes):]
        if fresh:
            h = hashed_words(b" ".join([word for _, word in fresh]))[0]
            seeds = {x: language_seed(x) for x in self.by_lang}
            self.hashes = np.concatenate([self.hashes, h ^ np.array([seeds[x] for x, _ in fresh], np.uint64)])
        return self.hashes

    def all_words(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """By number: the language (its place in ``by_lang``), the word after its language's head,
        and the word, as columns."""
        have = len(self.spelled[0]) if self.spelled else 0
        fresh = self.base[have:]
        if fresh:
            place = {lang: i for i, lang in enumerate(self.by_lang)}
            heads = pa.array([_head(lang) for lang in place] or [b""], pa.large_binary())
            of = np.array([place.get(lang, 0) for lang, _ in fresh], np.int32)
            words = pa.array([word for _, word in fresh], pa.large_binary())
            led = pc.binary_join_element_wise(heads.take(pa.array(of)), words, _NOTHING)
            if have:
                of = np.concatenate([self.spelled[0], of])
                led, words = (pa.concat_arrays(x) for x in ((self.spelled[1], led), (self.spelled[2], words)))
            self.spelled = of, led, words
        return self.spelled

    def count(self, w: np.ndarray, stop: int) -> Iterator[tuple]:
        """``(k, word numbers (n, k), hashes, counts)`` of the phrases that begin before ``stop``;
        the hashes are for tests."""
        h_of, size = self.all_hashes(), len(self.base)
        if self.first:
            c = np.bincount(w[:stop], minlength=size)
            c[0] = 0
            at = np.nonzero(c)[0]
            yield 1, at[:, None], h_of[at], c[at]
        if self.new is None:
            return
        word_in = self.new(h_of)
        word_in[0] = False
        flag, was = word_in[w], None
        if self.old is not None:
            old_in = self.old(h_of) & word_in
            was = old_in[w]
        ident, h = w, h_of[w]
        parts = None  # of the phrases of one word less: their word numbers, by identity
        for k in range(2, LONGEST + 1):
            at = np.nonzero(flag[:-1] & flag[1:])[0]
            at = at[at < len(w) - k + 1]
            key = ident[at] * size + w[at + k - 1]
            hk = mix(h[at] * _GOLD + h_of[w[at + k - 1]])
            uniq, where, inverse = np.unique(key, return_index=True, return_inverse=True)
            del key
            front = uniq // size
            words = np.empty((len(uniq), k), np.int32)
            words[:, :-1] = front[:, None] if parts is None else parts[front]
            words[:, -1] = uniq - front * size
            mine = at < stop
            if was is not None:  # counted in an earlier pass
                mine &= ~(was[at] & was[at + 1])
            c = np.bincount(inverse[mine], minlength=len(uniq))
            some = np.nonzero(c)[0]
            yield k, words[some], hk[where][some], c[some]
            inside = self.new(hk)
            flag = np.zeros(len(w), bool)
            flag[at[inside]] = True
            if was is not None:  # as the earlier pass saw it: its parts and itself in the old filter
                before = at[inside & was[at] & was[at + 1] & self.old(hk)]
                was = np.zeros(len(w), bool)
                was[before] = True
            ident, h = np.zeros(len(w), np.int64), np.zeros(len(w), np.uint64)
            ident[at], h[at], parts = inverse, hk, words


class _Words(Numbers):
    """The words of one language; all languages of a counter share one numbering."""

    def __init__(self, counter: Counter, lang: str):
        super().__init__()
        self.counter, self.lang = counter, lang
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.counter.base)
        self.counter.base.append((self.lang, word))
        return n


def blocks(langs: list[str], raws: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, str]], bool]]:
    """Translated texts joined to blocks: the bytes, where each text begins and its language,
    and whether the last text goes on in the next block, which then begins with the last
    ``LONGEST - 1`` words again."""
    held, places, size = [], [], 0
    for lang, raw in zip(langs, raws):
        raw = raw.translate(_BYTES) + b"\n"
        if size and size + len(raw) > BLOCK_BYTES:
            yield b"".join(held), places, False
            held, places, size = [], [], 0
        if len(raw) > BLOCK_BYTES:
            tail = b""
            *most, last = slices(raw, BLOCK_BYTES)
            for s in most:
                s = tail + s
                yield s, [(0, lang)], True
                start = hashed_words(s)[1]
                tail = s[start[max(0, len(start) - LONGEST + 1)]:] if len(start) else b""
            raw = tail + last
        held.append(raw)
        places.append((size, lang))
        size += len(raw)
    if held:
        yield b"".join(held), places, False


def few_phrases(buf: bytes, places: list[tuple[int, str]], open_end: bool, new: Filter, old: Filter) -> Iterator[tuple]:
    """Language and phrase of every occurrence that ``new`` admits and ``old`` did not."""
    h, start, end, piece = hashed_words(buf)
    firsts = np.array([p for p, _ in places])
    text_of = np.searchsorted(firsts, start, "right") - 1
    seeds = {lang: language_seed(lang) for _, lang in places}
    h = h ^ np.array([seeds[lang] for _, lang in places], np.uint64)[text_of]
    stop = len(h) - (LONGEST - 1) * open_end
    words, flag = h, new(h)
    was = flag & old(h)
    for k in range(2, LONGEST + 1):
        at = np.nonzero(flag[:-1] & flag[1:])[0]
        at = at[at < len(words) - k + 1]
        at = at[piece[at] == piece[at + k - 1]]
        hk = mix(h[at] * _GOLD + words[at + k - 1])
        mine = (at < stop) & ~(was[at] & was[at + 1])
        for i in at[mine].tolist():
            yield places[text_of[i]][1], b" ".join(buf[start[i]:end[i + k - 1]].split())
        inside = new(hk)
        before = at[inside & was[at] & was[at + 1] & old(hk)]
        flag, was, h = np.zeros(len(words), bool), np.zeros(len(words), bool), np.zeros(len(words), np.uint64)
        flag[at[inside]], was[before], h[at] = True, True, hk


def count_phrases(docs: DataFrame, new, old, first: bool, few: bool, support: int) -> DataFrame:
    """Exact counts ``lang, k, phrase, h, c`` of one pass over ``docs(lang, text)``: the phrases
    with the support that the filter ``new`` admits and ``old`` did not, and, if ``first``, all
    words, and a row of length 0 with each language's number of words. Both filters are broadcast
    variables. ``few`` reads without numbering every word, which is faster where few phrases are
    counted. Only the language and phrase, as one text, and the count are shuffled."""
    schema = pa.schema([("key", pa.string()), ("c", pa.int64())])

    def batch(keys: list[bytes] | pa.Array, c) -> pa.RecordBatch:
        return batch_of(schema, [pa.array(keys, pa.large_binary()).cast(pa.string()), c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*(Filter(x.value) if x is not None else None for x in (new, old)), first)
        held: list[np.ndarray] = []
        n = 0

        def rows(w: np.ndarray, stop: int) -> Iterator[pa.RecordBatch]:
            lang_of, led, words = counter.all_words()
            for k, numbers, _, c in counter.count(w, stop):
                for i in range(0, len(c), ROWS):
                    first, *more = numbers[i:i + ROWS].T
                    yield batch(pc.binary_join_element_wise(led.take(pa.array(first)), *[words.take(pa.array(x)) for x in more], _BLANK),
                                c[i:i + ROWS])
                if k == 1 and len(c):
                    total = np.zeros(len(counter.by_lang), np.int64)
                    np.add.at(total, lang_of[numbers[:, 0]], c)
                    some = np.nonzero(total)[0]
                    langs = list(counter.by_lang)
                    yield batch([_head(langs[i]) for i in some.tolist()], total[some])

        for b in batches:
            for lang, raw in zip(b.column("lang").to_pylist(), raw_texts(b)):
                for part in counter.read(lang, raw):
                    held.append(part)
                    n += len(part)
                    while n >= CHUNK + LONGEST:
                        w = np.concatenate(held)
                        yield from rows(w[:CHUNK + LONGEST - 1], CHUNK)
                        w = w[CHUNK:]
                        if len(counter.base) > VOCABULARY:
                            w = counter.renumber(w)
                        held, n = [w], len(w)
        if n:
            w = np.concatenate(held)
            yield from rows(w, len(w))

    def run_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filter(new.value), Filter(old.value)
        found: dict[tuple, int] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            yield batch([_head(lang) + phrase for lang, phrase in found], list(found.values()))
            found.clear()

        for b in batches:
            for block in blocks(b.column("lang").to_pylist(), raw_texts(b)):
                for key in few_phrases(*block, *filters):
                    found[key] = found.get(key, 0) + 1
                if len(found) > ROWS:
                    yield from rows()
        if found:
            yield from rows()

    out_schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("h", pa.int64()), ("c", pa.int64())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, phrases = zip(*(x.rsplit("\t", 1) for x in b.column("key").to_pylist())) if b.num_rows else ((), ())
            yield batch_of(out_schema, [list(langs), [len(x.split(" ")) if x else 0 for x in phrases], list(phrases),
                                        phrase_hashes(langs, phrases), b.column("c")])

    counted = docs.select("lang", "text").mapInArrow(run_few if few else run, "key string, c long")
    counted = counted.groupBy("key").agg(F.sum("c").alias("c")).where((F.col("c") >= support) | F.col("key").endswith("\t"))
    return counted.mapInArrow(parts, "lang string, k int, phrase string, h long, c long")


def _head(lang: str) -> bytes:
    return lang.encode("utf-8", "surrogatepass") + b"\t"  # no word holds a tab


def phrase_hashes(langs: Sequence[str], phrases: Sequence[str]) -> np.ndarray:
    """The hashes that the filters hold, of phrases given as texts."""
    seeds = {x: language_seed(x) for x in set(langs)}
    h, _, _, owner = hashed_words("\n".join(phrases).encode("utf-8", "surrogatepass"))
    h = h ^ np.array([seeds[x] for x in langs], np.uint64)[owner]
    words = np.bincount(owner, minlength=len(phrases))
    first = np.cumsum(words) - words
    out = np.zeros(len(phrases), np.uint64)
    out[words > 0] = h[first[words > 0]]
    for j in range(1, LONGEST):
        more = words > j
        out[more] = mix(out[more] * _GOLD + h[first[more] + j])
    return out.view(np.int64)


def filter_bits(phrases: DataFrame, n_bits: int) -> np.ndarray:
    """The bits of ``phrases(h)``, gathered by Spark's bitmap aggregate: ``n_bits / 8`` bytes."""
    both = [x.bitwiseAND(F.lit(n_bits - 1)) + 1 for x in (F.col("h"), F.shiftrightunsigned("h", 32))]
    blocks = (phrases.select(F.explode(F.array(*both)).alias("at"))
              .groupBy(F.bitmap_bucket_number("at").alias("block"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))
    out = np.zeros(n_bits // 8, np.uint8)
    for row in blocks.toLocalIterator():
        first = (row.block - 1) * 4096
        out[first:first + 4096] = np.frombuffer(row.bits, np.uint8)[:len(out) - first]
    return out


def bits_for(n: int) -> int:
    """A power of two of about ``BITS_PER_PHRASE`` bits a phrase, within the bounds."""
    return int(min(MAX_BITS, max(MIN_BITS, 1 << (max(1, n) * BITS_PER_PHRASE - 1).bit_length())))


def frequent_phrases(docs: DataFrame, support: int, proposed: DataFrame | None, staging: Staging,
                     few: bool = True) -> DataFrame:
    """Every phrase with the support, exactly counted, and the rows of length 0.

    ``proposed(h, k)`` may be any set; None proposes nothing, which is a plain search level by
    level. ``few`` tells that expansion passes count few phrases.
    """
    sc = docs.sparkSession.sparkContext
    short = f"k between 1 and {LONGEST - 1}"
    new = filter_bits(proposed.where(short), bits_for(proposed.count())) if proposed is not None else None
    old, found = None, None
    while True:
        sent = [sc.broadcast(x) if x is not None else None for x in (new, old)]
        counted = staging.write(count_phrases(docs, *sent, first=found is None, few=few and old is not None,
                                              support=support), "phrases")
        found = counted if found is None else found.union(counted)
        for x in sent:
            if x is not None:
                x.unpersist()
        more = filter_bits(counted.where(short), len(new) * 8 if new is not None else bits_for(
            4 * counted.where(short).count()))
        if new is not None:
            more |= new
            if (more == new).all():  # all that was found had been proposed: closed
                return found
        elif not more.any():
            return found
        old, new = new, more


def mine_phrases(docs: DataFrame, support: int = 30, sample: int = SAMPLE, lowered: int = LOWERED,
                 staging: Staging | None = None) -> DataFrame:
    """``lang, k, phrase, h, c`` of every phrase of one to four words that occurs ``support``
    times in its language (and a row with ``k`` 0: the words of that language).

    ``docs(lang, text)``; a sample of one document in ``sample`` is mined first.
    """
    staging = staging or Staging(docs.sparkSession, "collocations")
    drawn = staging.write(docs.where(F.pmod(F.xxhash64("row_key", "text"), F.lit(sample)) == 0)
                          .select("lang", "text"), "sample")
    proposal = staging.write(frequent_phrases(drawn, lowered, None, staging, few=False).where("k > 0").select("k", "h"), "proposal")
    return frequent_phrases(docs.select("lang", "text"), support, proposal, staging)


def mine_collocations(docs: DataFrame, support: int = 30, top: int = 2000, covered_percent: int = 80,
                      text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                      sample: int = SAMPLE, lowered: int = LOWERED) -> DataFrame:
    """The first ``top`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A candidate is a phrase of two to four words with ``a >= support`` occurrences within pieces;
    ``l`` and ``r`` are the counts of its two parts at the cut with the lowest score,
    floor(2000000 a / (l + r)), and of equal ones at the first; ``n`` is the number of words of
    the language. A candidate inside a longer one with at least ``covered_percent`` of its count
    goes. The id only takes part in drawing the sample and may be null or repeated; repeated rows
    count each. A null text is empty, a null language ``und``; blank texts and empty tables give
    no phrase. Ties fall by count, then by the phrase's bytes. Very long texts are read in
    slices. Other columns are not read.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    staging = Staging(spark, "collocations")
    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                         F.col(id_col).cast("string").alias("row_key"))
    found = mine_phrases(narrow, support, sample, lowered, staging)
    counts = found.where("k > 0").select("lang", "k", "phrase", "c")
    words = found.where("k = 0").select("lang", F.col("c").alias("n"))
    candidates = counts.where("k > 1").withColumn("w", F.split("phrase", " "))

    def joined(first, length):
        return F.array_join(F.slice("w", first, length), " ")

    cuts = (candidates.select("lang", "phrase", "w", "k", F.col("c").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
            .select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("left"),
                    joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right")))
    part = counts.select("lang", F.col("phrase").alias("part"), F.col("c").alias("f"))
    scored = (cuts.join(part.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
              .join(part.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
              .withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div "
                                          "(cast(l as decimal(19,0)) + cast(r as decimal(19,0)))").cast("long"))
              .groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("m")))
    inner = (candidates.where("k > 2")
             .select("lang", "w", "k", "c", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("length"))
             .select("lang", "w", "length", "c", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("length") + 1)).alias("first"))
             .groupBy("lang", joined(F.col("first"), F.col("length")).alias("phrase")).agg(F.max("c").alias("longer")))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.expr(f"longer is null or cast(100 as decimal(3,0)) * cast(longer as decimal(19,0)) "
                          f"< cast({int(covered_percent)} as decimal(3,0)) * cast(a as decimal(19,0))"))
            .select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.score").alias("score")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
