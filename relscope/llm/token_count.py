"""Token counts with overlap resynchronisation for huge documents (operator 6).

A position is a proven boundary of the byte-level BPE if the pre-tokenizer ends a piece there whatever stands before and
after: a single space between two characters that are not white space begins a new piece, and a letter that is followed by
white space, a digit or a punctuation mark ends one. Merges never cross pieces, and places inside special strings don't
count. Documents above `CHUNK` characters are encoded in overlapping chunks with offsets: two neighbours are spliced at a
proven boundary inside their overlap that both encodings have as the start of a token. When no such place exists the
overlap is widened, and a chunk without any boundary is doubled, so the work stays in proportion to the text. Shorter
documents are cut at the same proven boundaries into pieces whose counts are remembered, which gives the library's counts
at a fraction of the calls.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.llm.common import read

#: Characters of a chunk and of the first overlap; documents up to CHUNK characters are counted in one go.
CHUNK, OVERLAP = 1 << 15, 256
#: Pieces that a worker remembers before it starts anew, and the longest piece it remembers.
CACHE, CACHE_CHARS = 1 << 19, 64

TWO_SPACES = re.compile(r"\s\s")
# letters here are those of every version of Unicode: Latin, Greek, Cyrillic, kana, CJK ideographs, Hangul syllables
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
BOUNDARY = re.compile(rf"(?<=\S)(?= \S)|(?<=[{LETTER}])(?=[\t-\r!-@\[-`{{-~\u3001-\u3003\u3008-\u3011\uff01-\uff20])")
CUT = re.compile(r"(?<=\S)(?= \S)")


class Counter:
    """Counts the tokens of texts with one tokenizer file; splicing figures stay in `splices` and `widened`."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self.splices = self.widened = 0

    def _encode(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def short(self, text: str) -> int:
        """Tokens of a text that is not huge, piece by piece."""
        if TWO_SPACES.search(text):
            pieces = CUT.split(text)
        else:
            first, *rest = text.split(" ")
            pieces = [first, *(" " + p for p in rest)] if rest else [first]
        known = self.known
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            pass
        new = list({p for p in pieces if p not in known})
        got = dict(zip(new, (len(e.ids) for e in self.tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        total = sum(known[p] if p in known else got[p] for p in pieces)
        if len(known) + len(got) > CACHE:
            known.clear()
        known.update((p, n) for p, n in got.items() if len(p) <= CACHE_CHARS)
        return total

    def _offsets(self, text: str):
        """The encoding of a chunk, which knows the offsets of its tokens; special tokens are found as by default."""
        return self.tok.encode(text, add_special_tokens=False)

    @staticmethod
    def _token_at(encoding, place: int) -> int | None:
        """The number of the token that starts at a place of a chunk, None if none does."""
        i = encoding.char_to_token(place)
        return i if i is not None and encoding.token_to_chars(i)[0] == place else None

    def huge(self, text: str) -> int:
        """Tokens of a long text from overlapping chunks, each spliced to the last at a proven common boundary."""
        n, total, at = len(text), 0, 0  # all before `at` is counted; `at` is 0 or a proven boundary
        end = min(n, self.chunk)
        left, base, from_ = self._offsets(text[:end]), 0, 0  # the chunk from base on, of which from_ tokens are counted
        while end < n:
            overlap, cut = self.overlap, 0
            while not cut:
                back = max(at + 1, end - overlap)
                if self._last_boundary(text, back, end - 1):
                    far = min(n, end + self.chunk)
                    right = self._offsets(text[back:far])
                    cut = self._common(text, left, base, right, back, end)
                if cut or back == at + 1:
                    break
                self.widened += 1
                overlap *= 4
            if not cut:  # no proven boundary in the whole chunk: it is doubled
                end = min(n, end + max(self.chunk, end - at))
                left, base, from_ = self._offsets(text[at:end]), at, 0
                self.widened += 1
                continue
            self.splices += 1
            total += self._token_at(left, cut - base) - from_
            left, base, from_, at, end = right, back, self._token_at(right, cut - back), cut, far
        return total + len(left.ids) - from_

    def _last_boundary(self, text: str, lo: int, hi: int) -> int:
        """A proven boundary in [lo, hi) outside special strings, the last one, or 0."""
        last = 0
        for m in BOUNDARY.finditer(text, lo, hi):
            if not self._special(text, m.start()):
                last = m.start()
        return last

    def _special(self, text: str, at: int) -> bool:
        """Whether a special string can stand across the place."""
        return any(x in text[max(0, at - len(x) + 1) : at + len(x) - 1] for x in self.special)

    def _common(self, text: str, left, base: int, right, lo: int, hi: int) -> int:
        """The last proven boundary in (lo, hi - 1) at which both encodings, from base and lo on, start a token, or 0."""
        for m in reversed(list(BOUNDARY.finditer(text, lo + 1, hi - 1))):
            spot = m.start()
            if self._token_at(left, spot - base) is not None and self._token_at(right, spot - lo) is not None and not self._special(text, spot):
                return spot
        return 0

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return self.huge(text) if len(text) > self.chunk else self.short(text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows, null ids and ties each come back; other columns are
    not read. `path` names a byte-level BPE of the tokenizers library (by default byte_bpe_50k.json) that every worker
    can open. An empty table gives an empty result.
    """

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path or default_path(), chunk, overlap)
        for batch in texts:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), counted(F.col(text)).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
