"""Text quality statistics of documents, and which documents are no running text.

Every text is cut into tokens, tokens into units (a sentence, or a line that is
none), with array arithmetic over the bytes of an Arrow batch.  Tokens are
dictionary-encoded, so what depends on a token alone (letters, digits, symbols,
common word, bullet, sentence end) is found once for each distinct token; unit
and document statistics are sums over index ranges.  One narrow pass, no shuffle,
memory bound by a few MB of text (or one longer text) at a time.

Rules.  Units are held against fixed thresholds in the manner of the published
heuristic quality filters (symbols per word, words with letters, stop words,
bullets, ellipses or leaders, table separators, least length).  A unit that
passes is running text; one that fails has the first reason that applies; short
lines that head or page a decision are neutral.  Documents get the published
document rules too, with every reason that failed, and are junk if more than half
of their characters other than white space are in failing units.

Defined results of edge cases
* null, empty and blank text: counts 0, shares 0, reasons ``[blank]``, never junk
* lines end at LF, CR, form feed and vertical tab; no-break space is white space;
  soft hyphens, zero-width characters and byte order marks inside words are left out
* capitals throughout: words in capitals count as words
* repeated rows, null ids: each row judged by itself
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.tokens import WHITE, text_slices

CACHE_ENTRIES = 500_000

# thresholds of units
MIN_WORDS = 6  # tokens of a unit of running text
MIN_WORDS_ENDED = 5  # the same where the unit ends like a sentence
MAX_SYMBOLS = 0.12  # symbols per character
MIN_CLEAN = 0.5  # tokens that are words or plain numbers
MAX_NUMBERS = 0.4  # tokens with digits
MAX_PERIOD, LOOPED = 12, 0.8  # tokens that stand alike up to so many tokens before
MAX_HEADINGS = 8  # headings without text to head
MIN_UNITS = 4  # lines that head nothing if none of them is running text
MAX_TOKEN = 40  # characters of a word
LIST_RUN = 4  # consecutive lines that begin in lower case, hold a separator and no sentence end or beginning
# thresholds of documents (published values)
DOC_WORDS = (50, 100_000)
DOC_WORD_LENGTH = (3.0, 10.0)
DOC_SYMBOLS = 0.1
DOC_ALPHA = 0.8
DOC_BULLETS = 0.9
DOC_ELLIPSIS = 0.3
DOC_STOP_WORDS = 2
JUNK_SHARE = 0.5

REASONS = ["table", "leader", "repeated", "list", "bullet", "symbols", "numbers", "no_common_words", "too_short"]
DOC_REASONS = [
    "blank", "junk_share", "word_count", "word_length", "symbol_ratio", "alpha_words", "bullet_lines", "ellipsis_lines", "stop_words",
]

_FIELDS = [
    "chars", "word", "lower", "caps", "common", "digit", "symbol", "ends", "newline", "gap", "leader", "cell", "bullet",
    "letter_enum", "upper_start", "redacted", "real", "letters", "initial", "number_enum", "docket", "punct_end", "sep", "long",
]
_AT = {f: i for i, f in enumerate(_FIELDS)}

_HIDDEN = re.compile("[­​‌‍⁠﻿]")
_EDGE = "\"'“”„«»‹›‘’()[]{}.,;:!?…*_"
_PLAIN = set(" .,;:!?'\"()[]-–—/§%&’‘“”„«»‹›…€$")
_BULLETS = {"•", "-", "–", "—", "*", "·", "◦", "▪", "■", "‣", "o", "+", ">"}
_LETTER_ENUM = re.compile(r"^\(?[a-z]{1,2}\)$|^[A-Z]{1,3}[0-9]+:?$|^[IVX]+\.[0-9]+\.?$")
_NUMBER_ENUM = re.compile(r"^[\[(]?[0-9]{1,4}[\])]?\.?$")
_DOCKET = re.compile(r"^[0-9]{1,5}/[0-9]{2,4}$")
_SENTENCE_END = re.compile(r"(?:[^\W\d_]{4,}|[^\W_][\d:.,/]*\d[\d:.,/]*|\)|\]|[^\W\d_]{2,}|%)[.!?…]+[\"”“»’')\]]*$")
_ABBREVIATIONS = {"v.", "c.", "co.", "no.", "nr.", "para.", "rn.", "abs.", "art.", "al.", "f.", "ff.", "st.", "bzw.", "s.a.", "etc.", "cf.", "vgl."}


def token_features(fragment: str, common: frozenset[str]) -> tuple[int, ...]:
    """Features of a token with the white space after it, in the order of ``_FIELDS``."""
    body = fragment.strip()
    after = fragment[len(fragment.rstrip()) :]
    t = _HIDDEN.sub("", body)
    core = t.strip(_EDGE)
    letters = sum(map(str.isalpha, t))
    digits = sum(map(str.isdigit, t))
    flat = core.replace("-", "").replace("’", "").replace("'", "").replace("‑", "")
    is_word = 2 <= len(flat) <= MAX_TOKEN and flat.isalpha()
    caps = is_word and flat.isupper()
    lower = is_word and flat.islower()
    if is_word and not caps and not lower and not flat[1:].islower():
        parts = re.split(r"[-'’]", core)  # l'Office, HGB-V
        is_word = all(p[1:].islower() or p.isupper() or len(p) < 2 for p in parts)
        lower = is_word and parts[0].islower() and len(parts[-1]) > 1 and parts[-1].islower()
    low = core.lower()
    is_common = low in common or (("'" in low or "’" in low) and any(p in common for p in re.split(r"['’]", low) if len(p) > 1))
    symbols = sum(1 for c in t if not c.isalnum() and c not in _PLAIN)
    dots = len(t) > 0 and not t.strip("._…·")
    ends = bool(_SENTENCE_END.search(t[-64:])) and t.lower() not in _ABBREVIATIONS
    cells = t.count("|") + after.count("\t") + max(0, len(re.findall(r"[;,]\"|\";|;(?=[0-9\"])", t)) - 0)
    redacted = 0 < len(t) <= MAX_TOKEN and not t.strip("█*[]()…x.X_") and not dots
    return (
        len(t), is_word, lower, caps, is_common, digits > 0, symbols, ends, any(c in "\n\r\f\v" for c in after),
        after.count(" ") >= 2, dots, cells, t in _BULLETS, bool(_LETTER_ENUM.match(t)),
        core[:1].isupper(), redacted, bool(t), letters, len(core) == 1 and core.isalpha() and core.isupper(),
        bool(_NUMBER_ENUM.match(t)), bool(_DOCKET.match(core)), t[-1:] in set(".!?…\"”“»"),
        t[-1:] in set(",:;") or t in _BULLETS, len(t) > MAX_TOKEN,
    )


class Judge:
    """Features by distinct token, kept for the life of a worker: one column a field, a place a token."""

    _made: dict[frozenset[str], Judge] = {}

    def __init__(self, common: frozenset[str]):
        self.common = common
        self._forget()

    @classmethod
    def of(cls, common: frozenset[str]) -> Judge:
        if common not in cls._made:
            cls._made.clear()
            cls._made[common] = cls(common)
        return cls._made[common]

    def _forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.table = np.zeros((len(_FIELDS), 1 << 14), np.int32)
        self.used = 0

    def _places(self, fragments: list[bytes]) -> np.ndarray:
        """Place of each fragment in the table; new ones are worked out.  Long ones are not kept for later."""
        if self.used > CACHE_ENTRIES:
            self._forget()
        found = [self.places.get(f, -1) for f in fragments]
        out = np.array(found, np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            rows = np.array([token_features(fragments[i].decode("utf-8", "replace"), self.common) for i in new.tolist()], np.int32)
            end = self.used + len(new)
            if end > self.table.shape[1]:
                wider = np.zeros((len(_FIELDS), 2 * end), np.int32)
                wider[:, : self.used] = self.table[:, : self.used]
                self.table = wider
            self.table[:, self.used : end] = rows.T
            out[new] = np.arange(self.used, end)
            self.places.update((fragments[i], p) for i, p in zip(new.tolist(), range(self.used, end)) if len(fragments[i]) <= 64)
            self.used = end
        return out

    def judge(self, data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Statistics of each text; ``data`` holds the bytes of all, ``starts`` n + 1 offsets."""
        n = len(starts) - 1
        white = WHITE[data]
        if len(data) > 1:
            nbsp = (data[:-1] == 0xC2) & (data[1:] == 0xA0)
            white[:-1] |= nbsp
            white[1:] |= nbsp
        first = ~white
        first[1:] &= white[:-1]
        inner = starts[:-1][starts[:-1] < starts[1:]]
        begin = np.zeros(len(data) + 1, bool)
        begin[:-1] = first
        begin[inner] = True  # a text's leading white space goes with its first token, or stands alone
        begin[-1] = True
        offsets = np.flatnonzero(begin).astype(np.int32)
        if len(offsets) < 2:
            return self._documents(np.zeros(0, np.int64), np.zeros(0, np.int64), n)
        frags = pa.BinaryArray.from_buffers(
            pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        ).dictionary_encode()
        code = self._places(frags.dictionary.to_pylist())[frags.indices.to_numpy()]
        doc = np.repeat(np.arange(n), np.diff(np.searchsorted(offsets[:-1], starts)))
        real = self.table[_AT["real"]][code] > 0
        return self._documents(code[real], doc[real], n)

    def _documents(self, code: np.ndarray, doc: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """``code``: places of the tokens of all texts in order; ``doc``: the text of each."""
        columns: dict[str, np.ndarray] = {}

        def col(name):
            if name not in columns:
                columns[name] = self.table[_AT[name]][code]
            return columns[name]

        per = lambda w, by=doc, k=n: np.bincount(by, weights=w, minlength=k)
        m = len(code)
        out: dict[str, np.ndarray] = {}
        words = per(np.ones(m))
        chars = per(col("chars"))
        out["n_words"], out["n_chars"] = words, chars
        out["word_chars"] = per(col("chars") * (col("letters") > 0))
        out["alpha_words"] = per(col("letters") > 0)
        out["symbols"] = per(col("symbol"))
        out["common"] = per(col("common"))
        names = ["n_lines", "punct_lines", "bullet_lines", "ellipsis_lines", "prose", "neutral", "n_units"]
        if not m:
            for x in [*names, *REASONS]:
                out[x] = np.zeros(n)
            return out
        last_of_doc = np.append(doc[1:] != doc[:-1], True)
        nl = (col("newline") > 0) | last_of_doc
        line_start = np.append(True, nl[:-1])
        line = np.cumsum(line_start) - 1
        ls, le = np.flatnonzero(line_start), np.flatnonzero(nl)
        ended = (col("ends") > 0) | (nl & ~line_start & (col("number_enum") > 0) & (col("punct_end") > 0))
        line_doc = doc[ls]
        out["n_lines"] = per(np.ones(len(ls)), line_doc)
        out["punct_lines"] = per(col("punct_end")[le], line_doc)
        marked = (col("bullet") > 0) | (col("letter_enum") > 0)
        out["bullet_lines"] = per(marked[ls], line_doc)
        line_sum = lambda w: np.bincount(line, weights=w, minlength=len(ls))
        leader = col("leader") > 0
        out["ellipsis_lines"] = per(line_sum(leader) > 0, line_doc)

        # units: sentences of a line, or what a hard line break goes through
        nxt = lambda x, fill: np.append(x[1:], fill)
        next_lower = nxt(col("lower") > 0, False)
        next_upper = nxt((col("upper_start") > 0) | (col("digit") > 0), True)
        cells_in_line = line_sum(col("cell") + leader)
        flat_line = (col("lower")[ls] > 0) & (line_sum(ended) == 0) & (line_sum(col("sep")) > 0)
        flat_line &= line_sum((col("upper_start") > 0) & (col("common") > 0)) == 0
        # lines of one noun phrase each: they begin with a capital that no function word has, hold
        # nothing that begins or ends a sentence inside, and many of them end without a stop
        size_line = line_sum(np.ones(m))
        cells_line = line_sum(col("cell") + leader)
        opens = line_sum((col("upper_start") > 0) & (col("common") > 0)) == 0
        item = (col("upper_start")[ls] > 0) & opens & (line_sum(ended) - ended[le] == 0) & (cells_line == 0)
        item &= (size_line >= 4) & (size_line <= 18)
        listed = np.zeros(len(ls), bool)
        for which, open_share in ((flat_line, 0.0), (item, 0.3)):
            turn = np.append(True, (which[1:] != which[:-1]) | (line_doc[1:] != line_doc[:-1]))
            run = np.cumsum(turn) - 1
            length = np.bincount(run)
            unended = np.bincount(run, weights=~ended[le])
            listed |= which & ((length >= LIST_RUN) & (unended >= open_share * length))[run]
        soft = nl & ~listed[line] & ~last_of_doc & ~ended & next_lower & (cells_in_line[line] == 0) & (line_sum(np.ones(m))[line] >= 4)
        gap = (col("gap") > 0) & ~nxt(leader, False) & ~leader
        cut = last_of_doc | (nl & ~soft) | (ended & next_upper) | gap
        unit_start = np.append(True, cut[:-1])
        unit = np.cumsum(unit_start) - 1
        us, ue = np.flatnonzero(unit_start), np.flatnonzero(cut)
        k = len(us)
        s = lambda w: np.bincount(unit, weights=w, minlength=k)
        u_doc, u_line = doc[us], line[us]
        enum = (col("number_enum") > 0) | marked
        enum_first = enum[us]
        size = s(np.ones(m)) - enum_first
        u_chars = s(col("chars"))
        u_word, u_caps, u_common = s(col("word")), s(col("caps")), s(col("common"))
        u_low = s(col("lower"))
        u_digit = s(col("digit")) - (enum_first & (col("digit")[us] > 0))
        u_symbol = s(col("symbol"))
        u_end = ended[ue]
        all_caps = (u_caps >= 0.75 * np.maximum(u_word, 1)) & (u_word >= 3)
        low = np.where(all_caps, u_word, u_low)
        share = lambda a: a / np.maximum(size, 1)
        table = (s(col("cell")) >= 2) | ((cells_in_line[u_line] >= 2) & (size < 12))
        lead = s(leader) > 0
        bullet = marked[us] & (size <= 10)
        symbols = u_symbol > MAX_SYMBOLS * np.maximum(u_chars, 1)
        clean = (u_word + s((col("digit") > 0) & (col("symbol") == 0)) + s(col("initial"))) >= MIN_CLEAN * (size + enum_first)
        numbers = share(u_digit) > MAX_NUMBERS
        long_enough = (size >= MIN_WORDS) | ((size >= MIN_WORDS_ENDED) & u_end)
        spoken = ((low >= 3) | ((low >= 2) & u_end)) & (
            ((u_common >= 1) & u_end & (u_common >= 0.04 * size)) | ((u_common >= 1 + (size > 15)) & (u_common >= 0.06 * size)) | (u_end & (size <= 16) & (low >= 2) & (size >= 6))
        )
        again = np.zeros(m, bool)  # this token and the one before stand alike some tokens earlier
        for period in range(1, min(MAX_PERIOD, m - 1) + 1):
            alike = (code[period:] == code[:-period]) & (doc[period:] == doc[:-period])
            again[period + 1 :] |= alike[1:] & alike[:-1]
        looped = s(again)
        looped = (looped >= LOOPED * size) & (size >= 4)
        prose = ~table & ~lead & ~bullet & ~symbols & clean & ~numbers & long_enough & spoken & ~looped & ~listed[u_line]

        # the rest of a sentence that a line break or an abbreviation has cut off
        same_doc = np.append(False, u_doc[1:] == u_doc[:-1])
        before_open = np.append(False, ~u_end[:-1]) & same_doc
        broken = ~table & ~lead & ~symbols & ~bullet & (u_word >= 1) & ~enum_first & ~looped & ~listed[u_line]
        broken &= (size <= 10) | (u_common >= 0.04 * size)
        for _ in range(3):
            before = np.append(False, prose[:-1])
            after = np.append(prose[1:], False) & np.append(same_doc[1:], False)
            prose |= broken & before & before_open & ((low >= 1) | u_end)
            prose |= broken & after & ~u_end & (low >= 1) & (size >= 2) & (cells_in_line[u_line] == 0)

        # headings, party lines, page headers and redactions
        alone = (us == ls[u_line]) & (ue == le[u_line])
        titled = s((col("upper_start") > 0) | (col("common") > 0) | (col("lower") > 0)) >= size
        docket = (s(col("docket")) == 1) & (s(col("initial")) >= 1) & (u_word <= 6) & (col("digit")[us] + (s(col("word")) >= 2) > 0)
        quiet = ~table & ~lead & ~bullet & ~symbols & (size <= 8) & ~listed[u_line] & (s(col("long")) == 0)
        heading = quiet & (u_digit == 0) & titled & ~(u_end & (size >= 3))
        paged = quiet & (u_word >= 1) & (u_digit <= 2) & (size <= 4) & ~(col("digit")[us] > 0) & ~u_end & (u_common >= 1)
        hidden = (s(col("redacted")) >= size) & (size <= 4)
        single = (u_chars <= 4) & (u_word == 0) & (u_digit == 0) & alone
        own_docket = docket & (s(np.ones(m)) <= 5) & (u_word == 0)
        page_docket = docket & ~(col("digit")[us] > 0) & (u_word >= 2) & (s(col("punct_end")) == 0) & (u_symbol == 0) & (u_digit <= 3)
        page_docket &= s(col("common")) + s((col("upper_start") > 0)) >= 0.5 * size
        neutral = ~prose & alone & (heading | paged | hidden | single | own_docket | page_docket)

        reason = np.full(k, REASONS.index("too_short"))
        for name, mask in (("no_common_words", ~spoken & (size >= MIN_WORDS_ENDED)), ("numbers", numbers), ("symbols", symbols | ~clean), ("bullet", bullet), ("list", listed[u_line]), ("repeated", looped), ("leader", lead), ("table", table)):
            reason[mask] = REASONS.index(name)
        # page lines with hardly any text between them head nothing, nor do a few lines without any text
        n_neutral, c_neutral, c_prose = per(neutral, u_doc), per(u_chars * neutral, u_doc), per(u_chars * prose, u_doc)
        hollow = ((n_neutral > MAX_HEADINGS) & (c_neutral > c_prose)) | ((c_prose == 0) & (per(np.ones(k), u_doc) >= MIN_UNITS))
        reason[neutral & hollow[u_doc]] = REASONS.index("repeated")
        neutral &= ~hollow[u_doc]
        junk = ~prose & ~neutral
        out["n_units"] = per(np.ones(k), u_doc)
        out["prose"] = per(u_chars * prose, u_doc)
        out["neutral"] = per(u_chars * neutral, u_doc)
        for i, name in enumerate(REASONS):
            out[name] = per(u_chars * (junk & (reason == i)), u_doc)
        self.units = (us, ue, u_doc, prose, neutral, reason, u_chars)  # for inspection
        return out


_SCHEMA = (
    "n_words bigint, n_chars bigint, n_lines bigint, mean_word_length double, symbol_ratio double, alpha_word_share double, "
    "common_word_share double, punct_line_share double, bullet_line_share double, ellipsis_line_share double, "
    "prose_share double, junk_share double, main_reason string, reasons array<string>, is_junk boolean"
)


def _result(o: dict[str, np.ndarray]) -> list[pa.Array]:
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    words, chars, lines = o["n_words"], o["n_chars"], o["n_lines"]
    junk = np.stack([o[r] for r in REASONS])
    junk_share, alpha = ratio(junk.sum(0), chars), ratio(o["alpha_words"], words)
    symbol = ratio(o["symbols"] + o["ellipsis_lines"], words)
    mean_len = ratio(o["word_chars"], o["alpha_words"])
    blank = words == 0
    bullets, ellipsis = ratio(o["bullet_lines"], lines), ratio(o["ellipsis_lines"], lines)
    is_junk = (junk_share > JUNK_SHARE) & ~blank
    fails = np.stack(
        [
            blank,
            is_junk,
            (words < DOC_WORDS[0]) | (words > DOC_WORDS[1]),
            (mean_len < DOC_WORD_LENGTH[0]) | (mean_len > DOC_WORD_LENGTH[1]),
            symbol > DOC_SYMBOLS,
            alpha < DOC_ALPHA,
            bullets > DOC_BULLETS,
            ellipsis > DOC_ELLIPSIS,
            o["common"] < DOC_STOP_WORDS,
        ]
    )
    fails[1:, blank] = False
    which = fails.T
    flat = np.tile(np.arange(len(DOC_REASONS)), len(words))[which.reshape(-1)]
    reasons = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(which.sum(1))]).astype(np.int32)), pa.array(DOC_REASONS).take(pa.array(flat))
    )
    main = pa.array(REASONS).take(pa.array(junk.argmax(0), mask=junk.sum(0) == 0))
    whole = lambda x: pa.array(x.astype(np.int64))
    return [
        whole(words), whole(chars), whole(lines), pa.array(mean_len), pa.array(symbol), pa.array(alpha),
        pa.array(ratio(o["common"], words)), pa.array(ratio(o["punct_lines"], lines)), pa.array(bullets), pa.array(ellipsis),
        pa.array(ratio(o["prose"], chars)), pa.array(junk_share), main, reasons, pa.array(is_junk),
    ]


def text_statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and the statistics.  ``common_words`` (word) is a fixed list
    of a few hundred function words; more than 10,000 are refused, as they go to every worker."""
    words = [r[0] for r in common_words.select(F.lower("word")).where(F.col("word").isNotNull()).distinct().limit(10_001).collect()]
    if len(words) > 10_000:
        raise ValueError("common_words must be a short list of function words")
    common = frozenset(words)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", *[x.split()[0] for x in _SCHEMA.split(", ")]]

    def run(batches):
        judge = Judge.of(common)
        for batch in batches:
            for a, b, data, starts in text_slices(batch.column(1), 4 << 20):
                out = _result(judge.judge(data, starts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *out], names=names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, {_SCHEMA}").withColumnRenamed("_id", id_col)
