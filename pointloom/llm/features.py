"""Document features shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import Words, arrow_text, mix, pieces

NAMES = ["symbol_share", "upper_share", "repeat_share", "copied_share", "digit_share", "long_word_share", "log_words"]
LAGS, RUN = 8, 8
SCHEMA = "struct<" + ",".join(f"{n}:double" for n in NAMES) + ">"


def compute(column: pa.Array) -> list[np.ndarray]:
    """The features of each text, in the order of NAMES; zeros for texts
    without words (null, empty, blank).

    symbol_share, upper_share, digit_share: ASCII symbols other than .,;:'"()-?
    and /, ASCII capitals, and digits, over the bytes that are not whitespace.
    repeat_share: the largest share, over lags up to LAGS, of words equal to
    the word so many places before. copied_share: the share of runs of RUN
    words that stand earlier in the text, at any distance. long_word_share:
    words of over 40 bytes. log_words: ln(1 + words). Texts are read whole.
    """
    data, off = arrow_text(column)
    n = len(off) - 1
    out = np.zeros((len(NAMES), n))
    kind = np.zeros((3, 256), np.float64)
    kind[0, [ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~!"]] = 1
    kind[1, 65:91] = 1
    kind[2, 48:58] = 1
    packed = (kind[0] + 2 * kind[1] + 4 * kind[2]).astype(np.uint8)
    words = Words()
    for a, raw, o in pieces(data, off):
        w = words.split(raw, o)
        docs = slice(a, a + len(o) - 1)
        count = np.diff(w.at)
        have = count > 0
        kinds = packed[raw]
        total = np.zeros((4, len(raw) + 1))
        for k in range(3):
            np.cumsum(kinds == (1 << k), out=total[k, 1:])
        size = np.zeros(len(w.start) + 1)
        np.cumsum(w.end - w.start, out=size[1:])
        black = np.maximum(size[w.at[1:]] - size[w.at[:-1]], 1)
        for row, k in ((0, 0), (1, 1), (4, 2)):
            out[row, docs] = (total[k, o[1:]] - total[k, o[:-1]]) / black
        owner = np.repeat(np.arange(len(count)), count)
        best = np.zeros(len(count))
        for lag in range(1, LAGS + 1):
            if len(w.hash) <= lag:
                break
            same = (w.hash[lag:] == w.hash[:-lag]) & (owner[lag:] == owner[:-lag])
            best = np.maximum(best, np.bincount(owner[lag:], same, len(count)))
        out[2, docs] = best / np.maximum(count, 1)
        run, at = w.windows(RUN)
        whose = owner[at]
        # a run of another document is another run
        run = mix(run ^ whose.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(run)
        again = order[1:][run[order[1:]] == run[order[:-1]]]
        out[3, docs] = np.bincount(whose[again], minlength=len(count)) / np.maximum(count - RUN + 1, 1)
        out[5, docs] = np.bincount(owner, (w.end - w.start) > 40, len(count)) / np.maximum(count, 1)
        out[6, docs] = np.log1p(count)
        out[:, docs] *= have
    return list(out)


def features(text: str = "text") -> Column:
    """A struct of the features of a text column, computed in Arrow batches."""

    @F.arrow_udf(SCHEMA)
    def run(column: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(v) for v in compute(column)], NAMES)

    return run(F.col(text))
