"""Text statistics of documents, and how far a document is from its language's prose.

Statistics are taken from whole texts, in numpy over the code points of many texts at
once. Which words are common in a language, and which of them tie sentences together, is
learned from the corpus (``learn``). Per language, the centre and covariance of
prose are estimated robustly from all documents (concentration steps: the half of the
documents closest to the centre gives the next centre and covariance), and each
document gets its squared Mahalanobis distance with the part every statistic has in it.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.session import checkpointed

STATISTICS = ("log_words", "word_length", "symbol_ratio", "digit_ratio", "line_end_ratio", "common_ratio", "sentence_ratio", "distinct_ratio", "log_line_words")
# Spread below which a statistic's differences say nothing.
FLOORS = (1.2, 0.6, 0.06, 0.06, 0.4, 0.15, 0.1, 0.12, 0.8)
# The side on which a difference points away from prose: below, above, or both (0).
AWAY = (-1, 0, 1, 1, -1, -1, -1, -1, -1)
COMMON = STATISTICS.index("common_ratio")
# Words of a stretch within which different ones are counted.
STRETCH = 50
# The least share of words that tie a sentence.
TIED = 0.15

STATS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n_trimmed", T.LongType()),
        T.StructField("n_words", T.LongType()),
        *[T.StructField(s, T.DoubleType()) for s in STATISTICS],
    ]
)

# -- characters -------------------------------------------------------------
# Markup counts as a blank that ends a piece but no line; this private character stands for it.
TAG = "\ue000"
MARKUP = r"</?[A-Za-z][^<>]{0,200}>|&[A-Za-z]{2,8};|&#[0-9]{1,6};"
LINE_ENDS = "\n\r\u2028\u2029\u0085"
SENTENCE_ENDS = ".!?。！？…"
CLOSERS = "\"')]»”’>*_~"
PUNCTUATION = ".,!?'’\"“”…。、！？:;()-"
# Scripts written without blanks between words; each letter is a token.
UNSPACED = ((0x0E01, 0x0E30), (0x0E32, 0x0E33), (0x0E40, 0x0E46), (0x0E81, 0x0EB0), (0x0EC0, 0x0EC4), (0x1000, 0x102A), (0x1780, 0x17B3), (0x3005, 0x3006), (0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x2FFFF))
_SIZE = 0x30000
LETTER, WORD, BLANK, DIGIT, SYMBOL, LINE, HARD, END, CLOSER, WIDE, OWN, SLASH = (1 << i for i in range(12))


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, lower case and letter class of each code point."""
    kind, lower = np.zeros(_SIZE, np.uint16), np.arange(_SIZE, dtype=np.uint32)
    own = np.zeros(_SIZE, bool)
    for lo, hi in UNSPACED:
        own[lo : hi + 1] = True
    for i in range(_SIZE):
        c = chr(i)
        g = unicodedata.category(c)
        k = 0
        if g[0] in "LM":
            k |= WORD | (LETTER if g[0] == "L" else 0) | (OWN if own[i] and g[0] == "L" else 0)
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
        if g == "Nd":
            k |= DIGIT
        if c.isspace() or c == TAG:
            k |= BLANK | CLOSER
        elif g[0] not in "LMN" and c not in PUNCTUATION:
            k |= SYMBOL
        kind[i] = k
    for chars, k in ((LINE_ENDS, LINE | HARD), ("|│;\t#·•▪◦" + TAG, HARD), (SENTENCE_ENDS, END), (CLOSERS, CLOSER), ("。！？", WIDE), ("/", SLASH)):
        for c in chars:
            kind[ord(c)] |= k
    # Letters by code point up to Arabic, beyond by block; all ideographs are one.
    at = np.arange(_SIZE)
    letter = np.where(at < 0x600, at, 0x600 + (at >> 8))
    letter[(at >= 0x3400) & (at < 0xA000) | (at >= 0x20000) | (at >= 0xF900) & (at < 0xFB00)] = 0x600 + 0x4E
    letter[(at >= 0xAC00) & (at < 0xD7B0)] = 0x600 + 0xAC
    return kind, lower, letter.astype(np.int64)


_LETTERS = 0x600 + (_SIZE >> 8)


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hash(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each letter's part of the hash of the word it stands in, at ``place``."""
    with np.errstate(over="ignore"):
        return (codes.astype(np.uint64) + np.uint64(0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9) * _powers()[place & 255]


def word_hash(word: str) -> int:
    c = np.array([ord(x) for x in word], np.uint64)
    return int(_hash(c, np.arange(len(c))).sum(dtype=np.uint64))


class _Texts:
    """Characters, tokens, pieces and lines of some texts (cleaned of markup), as arrays."""

    def __init__(self, texts: list[str]):
        kinds, lower, _ = _table()
        size = np.array([len(t) + 1 for t in texts], np.int64)
        # A line end after each text keeps texts apart; it counts nowhere.
        code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n_docs = len(texts)
        self.first = np.cumsum(size) - size
        code = np.minimum(code, _SIZE - 1)
        self.code = lower[code]
        k = self.kind = kinds[code]
        self.doc = np.repeat(np.arange(len(texts)), size)
        n = len(k)
        at = np.arange(n)
        is_ = lambda bit: (k & bit) > 0
        before = lambda v: np.r_[False, v[:-1]]
        blank, own, word = is_(BLANK), is_(OWN), is_(WORD)
        self.blank, self.own = blank, own
        # Tokens: runs of letters and marks with a letter, or single letters of unspaced scripts.
        run = word & ~own
        start = run & ~before(run) | own
        t = np.flatnonzero(start)
        inside = run | own
        begun = np.maximum.accumulate(np.where(start, at, 0))
        part = np.where(inside, _hash(self.code, at - begun), np.uint64(0))
        if len(t):
            long = np.add.reduceat(inside.astype(np.int64), t)
            real = np.add.reduceat(is_(LETTER).astype(np.int64), t) > 0
            self.token, self.length, self.hash = t[real], long[real], np.add.reduceat(part, t)[real]
        else:
            self.token, self.length, self.hash = t, t, part[:0]
        self.token_own = own[self.token]
        # Pieces end at hard separators, after sentence ends and in wide gaps.
        b1 = before(blank)
        new = is_(HARD) | blank & before(is_(END)) | before(is_(WIDE)) | blank & b1 & before(b1)
        new[self.first] = True
        self.piece = np.cumsum(new) - 1
        self.n_pieces = int(self.piece[-1]) + 1
        self.piece_doc = self.doc[new]
        self.solid = np.bincount(self.piece, ~blank, self.n_pieces)
        self.ended = self._ends(self.piece, self.n_pieces, np.array([ord(c) for c in SENTENCE_ENDS]))
        # Letters within stretches that hold a slash (paths, n/a) make no words of a piece.
        stretch = np.cumsum(~blank & before(blank))
        slashed = np.bincount(stretch, is_(SLASH))[stretch[self.token]] > 0
        of = self.piece[self.token]
        self.counted = ~slashed
        self.tokens = np.bincount(of, self.counted, self.n_pieces)
        self.letters = np.bincount(of, self.counted * self.length, self.n_pieces)
        self.unspaced = np.bincount(of, self.counted & self.token_own, self.n_pieces) * 2 > self.letters

    def _ends(self, group: np.ndarray, n: int, ends: np.ndarray) -> np.ndarray:
        """Is the last character of a group, closers aside, one of ``ends``?"""
        last = np.full(n, -1)
        solid = np.flatnonzero((self.kind & CLOSER) == 0)
        last[group[solid]] = solid  # the last assignment stays
        return (last >= 0) & np.isin(self.code[last], ends)

    def per_doc(self, weight) -> np.ndarray:
        return np.bincount(self.doc, weight, self.n_docs)

    def presence(self) -> np.ndarray:
        """docs × letter classes: is a letter of the class in the text?"""
        at = np.flatnonzero((self.kind & LETTER) > 0)
        out = np.zeros((self.n_docs, _LETTERS), bool)
        out[self.doc[at], _table()[2][self.code[at]]] = True
        return out


def _clean(column):
    """Texts with markup replaced, null as empty; Arrow's string column in, list of str out."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.replace_substring_regex(text, MARKUP, TAG).to_pylist()


def _portions(texts: list[str], most: int = 200_000):
    """Ranges of texts of about ``most`` characters together; a longer text stands alone."""
    a = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield a, i
            a, total = i, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


# -- what is learned of languages --------------------------------------------
# Names and three-letter codes of languages whose first letters aren't the two-letter code.
NAMES = {
    "english": "en", "german": "de", "ger": "de", "deutsch": "de", "french": "fr", "français": "fr", "francais": "fr", "spanish": "es", "spa": "es", "español": "es", "espanol": "es",
    "italian": "it", "italiano": "it", "russian": "ru", "русский": "ru", "japanese": "ja", "jpn": "ja", "jp": "ja", "日本語": "ja", "chinese": "zh", "chi": "zh", "cn": "zh", "中文": "zh",
    "korean": "ko", "한국어": "ko", "polish": "pl", "pol": "pl", "polski": "pl", "portuguese": "pt", "por": "pt", "dutch": "nl", "dut": "nl", "turkish": "tr", "swedish": "sv", "swe": "sv",
}


def declared(lang: str | None) -> str:
    """The language a label means, ``und`` if it names none: a name of ``NAMES``, or a code of
    two or three letters in any case, of which a region may follow."""
    label = (lang or "").strip().lower()
    code = label.replace("_", "-").split("-")[0]
    for x in (label, code):
        if x in NAMES:
            return NAMES[x]
    return code[:2] if len(code) in (2, 3) and code.isascii() and code.isalpha() else "und"


@dataclass
class Words:
    """Learned of each language: common words, those of them that tie sentences, and letters.

    usual: the share of common words in sentences.
    """

    languages: list[str] = field(default_factory=list)
    common: dict[str, list[str]] = field(default_factory=dict)
    ties: dict[str, list[str]] = field(default_factory=dict)
    usual: dict[str, float] = field(default_factory=dict)
    letters: dict[str, list[int]] = field(default_factory=dict)

    def tables(self):
        """hashes (sorted), and for each its membership by language among common words and ties."""
        if not hasattr(self, "_tables"):
            words = sorted({w for v in self.common.values() for w in v}, key=word_hash)
            col = {c: i for i, c in enumerate(self.languages)}
            row = {w: i for i, w in enumerate(words)}
            # The last column is for texts of no learned language.
            c, t = (np.zeros((len(words), len(col) + 1), bool) for _ in range(2))
            for m, of in ((c, self.common), (t, self.ties)):
                for k, v in of.items():
                    m[[row[w] for w in v], col[k]] = True
            known = np.zeros((len(col), _LETTERS), bool)
            for k, v in self.letters.items():
                known[col[k], v] = True
            self._tables = np.array([word_hash(w) for w in words], np.uint64), c, t, known
        return self._tables


LEARNED = T.StructType([T.StructField("code", T.StringType()), T.StructField("word", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("sentence", "fragment", "docs")]])


class _Learned:
    """LEARNED counts of many texts: words in sentences and in fragments, and letters (a blank and a class)."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.words: dict[int, str] = {}
        self.counts: list[np.ndarray] = []  # rows of code, hash (as signed), and the three counts
        self.letters = np.zeros((0, _LETTERS + 1), np.int64)

    def add(self, texts: list[str], codes: list[str]) -> None:
        lang = np.array([self.codes.setdefault(c, len(self.codes)) for c in codes])
        x = _Texts(texts)
        of = x.piece[x.token]
        sentence = (x.ended & (x.tokens >= np.where(x.unspaced, 12, 7)))[of] & x.counted
        fragment = (x.tokens <= np.where(x.unspaced, 8, 5))[of] & x.counted
        use = np.flatnonzero(sentence | fragment)
        if len(use):
            order = use[np.lexsort((x.hash[use], lang[x.doc[x.token[use]]]))]
            d = x.doc[x.token[order]]
            h, g = x.hash[order], lang[d]
            new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
            k = np.flatnonzero(new)
            first = np.r_[True, d[1:] != d[:-1]] | new
            self.counts.append(np.column_stack([g[k], h[k].view(np.int64), *[np.add.reduceat(v.astype(np.int64), k) for v in (sentence[order], fragment[order], first)]]))
            for i, v in zip(order[k], h[k].tolist()):
                if v not in self.words:
                    p = x.token[i]
                    self.words[v] = "".join(map(chr, x.code[p : p + x.length[i]]))
        grown = np.zeros((len(self.codes), _LETTERS + 1), np.int64)
        grown[: len(self.letters)] = self.letters
        seen = x.presence()
        for i in np.unique(lang):
            grown[i, :-1] += seen[lang == i].sum(axis=0)
            grown[i, -1] += (lang == i).sum()
        self.letters = grown
        if len(self.counts) > 64:
            self.fold()

    def fold(self) -> np.ndarray:
        """Counts of equal words added up."""
        c = np.concatenate(self.counts) if self.counts else np.zeros((0, 5), np.int64)
        c = c[np.lexsort((c[:, 1], c[:, 0]))]
        if len(c):
            k = np.flatnonzero(np.r_[True, (c[1:, :2] != c[:-1, :2]).any(axis=1)])
            c = np.column_stack([c[k, :2], np.add.reduceat(c[:, 2:], k)])
        self.counts = [c]
        return c

    def batch(self):
        """What was added so far as a record batch; starts anew."""
        import pyarrow as pa

        names, c = list(self.codes), self.fold()
        code, word = [names[i] for i in c[:, 0]], [self.words[v] for v in c[:, 1].view(np.uint64).tolist()]
        g, of = np.nonzero(self.letters)
        code += [names[i] for i in g]
        word += [f" {k}" if k < _LETTERS else " " for k in of]
        zero, docs = np.zeros(len(g), np.int64), self.letters[g, of]
        numbers = [np.r_[c[:, 2], zero], np.r_[c[:, 3], zero], np.r_[c[:, 4], docs]]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(code, pa.string()), pa.array(word, pa.string()), *map(pa.array, numbers)], names=LEARNED.names)


def _learn_partition(batches):
    total = _Learned()
    for b in batches:
        texts, codes = _clean(b.column(0)), [declared(g) for g in b.column(1).to_pylist()]
        for i, j in _portions(texts, 400_000):
            total.add(texts[i:j], codes[i:j])
        if len(total.words) > 500_000:
            yield total.batch()
    yield total.batch()


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", *, least_docs: int = 20, share: float = 0.001, ratio: float = 4.0, letter_docs: float = 0.02) -> Words:
    """The ``Words`` of all languages that at least ``least_docs`` documents declare.

    Every document is counted. A word is common if it makes up ``share`` of a language's words in
    sentences (pieces of seven words and more that end like one), so a language has at
    most 1 / ``share`` of them. It ties sentences if that is ``ratio`` times its share of the words in
    fragments (pieces of five words or fewer): articles and adjectives stand in lists as
    well, pronouns and conjunctions don't. Letters are known if ``letter_docs`` of a
    language's documents have them.
    """
    said = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    each = docs.select(F.col(text).cast("string"), said).mapInArrow(_learn_partition, LEARNED)
    n = checkpointed(each.groupBy("code", "word").agg(*[F.sum(c).alias(c) for c in ("sentence", "fragment", "docs")]))
    letter = F.col("word").startswith(" ")
    totals = n.groupBy("code").agg(F.sum("sentence").alias("s"), F.sum("fragment").alias("f"), F.max(F.when(F.col("word") == " ", F.col("docs"))).alias("d")).where((F.col("code") != "und") & (F.col("d") >= least_docs) & (F.col("s") > 0))
    few = n.join(F.broadcast(totals), "code").where(F.when(letter, F.col("docs") >= letter_docs * F.col("d")).otherwise((F.col("docs") >= 3) & (F.col("sentence") >= share * F.col("s"))))
    return _words([tuple(r) for r in few.collect()], ratio)  # at most 1 / share words and 2,304 letters a language


def _words(rows, ratio: float) -> Words:
    """Words of rows (code, word, sentence, fragment, docs, and the language's totals of these)."""
    w = Words(languages=sorted({r[0] for r in rows if not r[1].startswith(" ")}))
    for code, word, s, f, _, ts, tf, _ in sorted(rows):
        if word.startswith(" "):
            if word != " " and code in w.languages:
                w.letters.setdefault(code, []).append(int(word))
            continue
        w.common.setdefault(code, []).append(word)
        w.usual[code] = w.usual.get(code, 0.0) + s / ts
        # Where a language has next to no fragments, a twentieth of its sentences stands in for them.
        if s / ts >= ratio * f / (tf + ts / 20):
            w.ties.setdefault(code, []).append(word)
    return w


# -- statistics ---------------------------------------------------------------
def _language(x: _Texts, words: Words, codes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: column of its language (the last: none that is learned); tokens; and the hits."""
    hashes, common, _, known = words.tables()
    nl = len(words.languages)
    doc = x.doc[x.token]
    counted = x.counted
    n = np.bincount(doc, counted, x.n_docs)
    if nl == 0:
        return np.zeros(x.n_docs, int), n, np.zeros(0, int), np.zeros(0, int)
    at = np.minimum(np.searchsorted(hashes, x.hash), len(hashes) - 1)
    hit = np.flatnonzero((hashes[at] == x.hash) & counted)
    at = at[hit]
    met = np.column_stack([np.bincount(doc[hit], common[at, j], x.n_docs) for j in range(nl)])
    col = {c: i for i, c in enumerate(words.languages)}
    said = np.array([col.get(c, -1) for c in codes])
    unlabelled = np.array([c == "und" for c in codes])
    rows = np.arange(x.n_docs)
    best = (met + 0.5 * (said[:, None] == np.arange(nl))).argmax(axis=1)
    found = met[rows, best] / np.maximum(n, 1) / np.array([words.usual[c] for c in words.languages])[best]
    # Without a third of the usual common words the label decides, if it and the letters agree.
    held = np.where(said >= 0, said, best)
    letters = np.flatnonzero((x.kind & LETTER) > 0)
    of = x.doc[letters]
    strange = np.bincount(of, ~known[held[of], _table()[2][x.code[letters]]], x.n_docs)
    fits = (strange <= 0.03 * np.bincount(of, minlength=x.n_docs)) & ((said >= 0) | unlabelled & (found >= 0.1))
    return np.where(found >= 1 / 3, best, np.where(fits, held, nl)), n, hit, at


def _statistics(texts: list[str], codes: list[str], words: Words) -> tuple[list[str], np.ndarray, np.ndarray]:
    """language, n_words, and the matrix of ``STATISTICS``, one row per text."""
    x = _Texts(texts)
    lang, n, hit, at = _language(x, words, codes)
    _, common, ties, _ = words.tables()
    doc = x.doc[x.token]
    nl = len(words.languages)
    of = x.piece[x.token]
    if nl:
        g = lang[doc[hit]]
        k_ties = np.bincount(of[hit], ties[at, g], x.n_pieces)
        share = np.bincount(doc[hit], common[at, g], x.n_docs) / np.maximum(n, 1)
    else:
        k_ties = np.zeros(x.n_pieces)
        share = np.zeros(x.n_docs)
    least = np.where(x.unspaced, 8, 4)
    tied = k_ties >= np.maximum(TIED * x.tokens, 1)
    reads = np.where(lang[x.piece_doc] == nl, x.ended, tied)
    good = (x.tokens >= least) & (x.letters >= 0.6 * x.solid) & reads
    total = np.bincount(x.piece_doc, x.solid, x.n_docs)
    sentence = np.bincount(x.piece_doc, x.solid * good, x.n_docs) / np.maximum(total, 1)
    # Words: half as many as letters where letters aren't parted by blanks.
    own = np.bincount(doc, x.token_own, x.n_docs)
    spaced = np.bincount(doc, ~x.token_own, x.n_docs)
    n_words = (spaced + np.ceil(own / 2)).astype(np.int64)
    letters = np.bincount(doc, x.length, x.n_docs)
    solid = np.maximum(total, 1)
    new = (x.kind & LINE) > 0
    new[x.first] = True
    line = np.cumsum(new) - 1
    n_lines = int(line[-1]) + 1
    filled = np.bincount(line, ~x.blank, n_lines) > 0
    ended = x._ends(line, n_lines, np.array([ord(c) for c in SENTENCE_ENDS + ":"]))
    line_doc = x.doc[new]
    lines = np.maximum(np.bincount(line_doc, filled, x.n_docs), 1)
    # Different words within stretches of words, so that long texts don't seem monotonous.
    began = np.searchsorted(doc, np.arange(x.n_docs))
    stretch = doc * (1 << 40) + (np.arange(len(doc)) - began[doc]) // STRETCH
    order = np.lexsort((x.hash, stretch))
    h, d = x.hash[order], stretch[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])][: len(h)]
    distinct = np.bincount(doc[order[first]], minlength=x.n_docs)
    tokens = np.maximum(own + spaced, 1)
    m = np.column_stack(
        [
            np.log1p(n_words),
            letters / np.maximum(n_words, 1),
            x.per_doc((x.kind & SYMBOL) > 0) / solid,
            x.per_doc((x.kind & DIGIT) > 0) / solid,
            np.bincount(line_doc, ended & filled, x.n_docs) / lines,
            share,
            sentence,
            distinct / tokens,
            np.log1p(n_words / lines),
        ]
    )
    names = np.array([*words.languages, ""], object)[lang]
    return [a or "und" for a in names], n_words, np.where(total[:, None] > 0, m, 0.0)


def statistics(text: str | None, lang: str | None = None, words: Words | None = None) -> tuple:
    """language, n_chars, n_trimmed (without blanks at the ends), n_words and ``STATISTICS``.

    Null counts as empty: all zero. Markup tags and entities count as blanks. Words are
    runs of letters; of scripts without blanks (Japanese, Chinese, Thai), n_words is half
    the letters. language is that of ``words`` with most common words in the text if they are a third
    of what is usual (for a text without a label a tenth), else the declared one, and ``und`` if
    that isn't known or more than 3 % of the letters aren't its own. symbol_ratio and digit_ratio are shares of the characters
    that aren't blank; line_end_ratio is the share of lines that end in punctuation,
    common_ratio that of common words, distinct_ratio that of different words within stretches
    of 50. sentence_ratio is the share of characters in pieces
    (parts of lines up to a full stop) that read as sentences: letters for the most part,
    at least four words (eight letters in unspaced scripts), enough of them words that tie
    sentences, or, in ``und``, an end like a sentence's.
    """
    import pyarrow as pa

    words = words or Words()
    plain = text or ""
    language, n_words, m = _statistics(_clean(pa.array([plain])), [declared(lang)], words)
    empty = not plain.strip()
    code = declared(lang)
    return (code if empty else language[0], len(plain), len(plain.strip()), int(n_words[0]), *map(float, m[0]))


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", words: Words | None = None) -> DataFrame:
    """``STATS`` columns, one row per row of ``docs``; other columns are left aside.

    Null keys and repeated rows are kept as they are. ``lang`` may be null, wrong or
    missing from ``docs``. Without ``words``, they are learned from ``docs``.
    """
    words = learn(docs, text, lang) if words is None else words

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            raw = pc.fill_null(b.column(1), "")
            chars, trimmed = pc.utf8_length(raw), pc.utf8_length(pc.utf8_trim_whitespace(raw))
            texts, codes = _clean(b.column(1)), [declared(g) for g in b.column(2).to_pylist()]
            got = [_statistics(texts[i:j], codes[i:j], words) for i, j in _portions(texts)]
            if not got:
                continue
            language, n_words, m = [x for g in got for x in g[0]], np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
            empty = trimmed.to_numpy(zero_copy_only=False) == 0
            language = [c if e else x for c, e, x in zip(codes, empty, language)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(language, pa.string()), chars.cast(pa.int64()), trimmed.cast(pa.int64()), pa.array(n_words), *[pa.array(np.ascontiguousarray(m[:, i])) for i in range(m.shape[1])]], names=STATS.names)

    said = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string"), said).mapInArrow(run, STATS)


def _matrix(batch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in STATISTICS]) if batch.num_rows else np.zeros((0, len(STATISTICS)))


def _parts(x: np.ndarray, language: list, fits: dict) -> np.ndarray:
    """Each statistic's part in the squared distance, row by row.

    ``fits``: language -> (centre, inverse covariance), '' for languages without their own,
    of which no common words are known: that statistic is left out. Only differences on the
    side that points away from prose (``AWAY``) count.
    """
    out = np.zeros_like(x)
    of = np.array([k if k in fits else "" for k in language], object)
    for k in set(of.tolist()):
        at = np.flatnonzero(of == k)
        m, inv = fits[k]
        delta = x[at] - m
        delta = np.where(np.multiply(AWAY, delta) < 0, 0.0, delta)
        out[at] = delta * (delta @ inv)
    return out


def _moments(stats: DataFrame, fits: dict, limit: dict[str, float]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """language -> (n, mean, covariance) over rows no farther than the language's limit."""
    d = len(STATISTICS)

    def sums(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for b in batches:
            x, lang = _matrix(b), b.column(0).to_pylist()
            near = _parts(x, lang, fits).sum(axis=1) <= np.array([limit.get(k, np.inf) for k in lang])
            of = np.array(lang, object)
            for k in set(lang):
                y = x[near & (of == k)]
                v = np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y).ravel()])
                total[k] = total.get(k, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["language", "v"])

    each = stats.select("language", *STATISTICS).mapInArrow(sums, "language string, v array<double>")
    total = each.select("language", F.posexplode("v").alias("i", "x")).groupBy("language", "i").agg(F.sum("x").alias("x")).groupBy("language").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    out = {}
    for r in total.collect():  # as many rows as languages
        v = np.array([y["x"] for y in r["v"]])
        n = v[0]
        if n:
            m = v[1 : d + 1] / n
            out[r["language"]] = (n, m, v[d + 1 :].reshape(d, d) / n - np.outer(m, m))
    return out


def _pooled(fits: dict) -> tuple[float, np.ndarray, np.ndarray]:
    n = sum(f[0] for f in fits.values())
    m = sum(f[0] * f[1] for f in fits.values()) / n
    c = sum(f[0] * (f[2] + np.outer(f[1] - m, f[1] - m)) for f in fits.values()) / n
    return n, m, c


def _inverse(cov: np.ndarray, without: int | None = None) -> np.ndarray:
    """Inverse of a covariance with the floors on its diagonal, of all statistics or of all but one."""
    c = cov + np.diag(np.square(FLOORS))
    if without is None:
        return np.linalg.inv(c)
    rest = [i for i in range(len(c)) if i != without]
    out = np.zeros_like(c)
    out[np.ix_(rest, rest)] = np.linalg.inv(c[np.ix_(rest, rest)])
    return out


def _scored(stats: DataFrame, fits: dict) -> DataFrame:
    """``stats`` with distance double and contributions array<double>."""
    names = stats.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            p = _parts(_matrix(b), b.column(names.index("language")).to_pylist(), fits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.sum(axis=1)), pa.array(p.tolist(), pa.list_(pa.float64()))], names=[*names, "distance", "contributions"])

    return stats.mapInArrow(run, T.StructType([*stats.schema.fields, T.StructField("distance", T.DoubleType()), T.StructField("contributions", T.ArrayType(T.DoubleType()))]))


def fit_prose(stats: DataFrame, *, steps: int = 4, least: int = 100) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """language -> (centre, inverse covariance) of prose, '' for all languages together.

    ``stats`` is read several times and should be a written table. Start: per language
    the half of its documents (of at least one word) nearest to the medians; each step takes
    the half nearest by the last fit. At the end all documents within the 0.975 quantile,
    scaled so that the half's median distance is what it is for normal data, give the last
    fit. A language with fewer than ``least`` such documents is measured by the fit over all;
    if its common words are known, with them ('' and its name), else without (see ``_parts``).
    """
    d = len(STATISTICS)
    some = stats.where(F.col("n_words") > 0)
    mid = lambda c: F.percentile_approx(c, 0.5, 10_000)
    med = {r["language"]: np.array([r[s] for s in STATISTICS], float) for r in some.groupBy("language").agg(*[mid(s).alias(s) for s in STATISTICS]).collect()}
    flat = np.diag(1 / np.square(FLOORS))
    if not med:
        return {"": (np.zeros(d), flat)}
    fits = {k: (m, flat) for k, m in med.items()}
    fits[""] = fits.get("und", (np.mean(list(med.values()), axis=0), flat))
    # Quantiles of chi squared with 9 degrees of freedom: 0.5, 0.975.
    half, most = 8.343, 19.023
    for step in range(steps + 1):
        near = _scored(some.select("language", *STATISTICS), fits).groupBy("language").agg(mid("distance").alias("c")).collect()
        limit = {r["language"]: r["c"] * (most / half if step == steps else 1.0) for r in near}
        moments = {k: f for k, f in _moments(some, fits, limit).items() if k != "und"}
        enough = {k: f for k, f in moments.items() if f[0] >= least / 2}
        every = _pooled(enough or moments) if moments else (0, fits[""][0], np.zeros((d, d)))
        own = {k: (f[1], _inverse(f[2])) for k, f in enough.items()}
        fits = {k: (every[1], _inverse(every[2])) for k in moments} | own | {"": (every[1], _inverse(every[2], COMMON))}
    return fits


def outlierness(stats: DataFrame, fits: dict | None = None) -> DataFrame:
    """``stats`` with distance (squared) and contributions map<string,double>.

    The contributions, one per statistic, add up to the distance.
    """
    scored = _scored(stats, fits or fit_prose(stats))
    return scored.withColumn("contributions", F.map_from_arrays(F.array(*[F.lit(x) for x in STATISTICS]), "contributions"))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, distance and contributions of every document of ``docs``."""
    return outlierness(checkpointed(document_statistics(docs, key, text)))


def not_prose(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = 40, far: float = 27.877) -> DataFrame:
    """doc_id of texts that aren't natural prose for the most part.

    Of texts with at least ``least_chars`` characters after trimming, those outlying from their
    language's prose: squared distance over ``far``, chi squared's 0.999 quantile at 9
    degrees of freedom. With the floor of the share of sentences at a tenth, a text of
    whose characters about half stand in no sentence is that far. Null texts are never listed.
    """
    return score(docs, key, text).where((F.col("n_trimmed") >= least_chars) & (F.col("distance") > far)).select("doc_id")
