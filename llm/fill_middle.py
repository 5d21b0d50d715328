"""Fill-in-middle: texts cut at two places into prefix, middle and suffix and put in another order.

Cuts are given in code points, texts are stored in bytes. All boundaries between code points of a
run of texts go into one learned rank index (`rank_index`): lines with a bounded error, and stored
residuals. Each cut is predicted from its number and corrected exactly, so texts are cut as bytes and never decoded.

The draws come from the SHA-256 of a seed and doc_id, hence repeated rows are treated alike and the outcome
does not depend on order or partitions. A text stays plain if it is empty, holds one of the marks, or is
drawn so. Null texts are empty; a null doc_id is drawn like the empty string. Every row gives one row;
columns other than doc_id and text are not looked at, unless named in `carry`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.rank_index import code_points
from llm.words import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
PLAIN_FROM, SPM_BELOW = 90, 20
SHAPE = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(key: Column, seed: str = "1") -> Column:
    """Four whole numbers below 2^32 from the SHA-256 of seed:key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def _rearranged(raw: np.ndarray, offsets: np.ndarray, drawn: np.ndarray, spm_below: int) -> dict[str, list]:
    """Rows of a slice of texts; `drawn` holds the two cut draws, whether to stay plain, and the form's draw."""
    index = code_points(raw)
    before = (raw & 0xC0) != 0x80
    # Number of each text's first boundary: code points before it in the slice.
    counts = np.add.reduceat(np.append(before, False).astype(np.int64), offsets[:-1]) if len(offsets) > 1 else offsets[:0]
    counts[offsets[:-1] == offsets[1:]] = 0
    first = np.concatenate([[0], np.cumsum(counts)])
    units = np.diff(first)
    one, two = drawn[:, 0] % (units + 1), drawn[:, 1] % (units + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    cuts = index.locate(np.concatenate([first[:-1] + low, first[:-1] + high]))
    text = raw.tobytes()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out: dict[str, list] = {"n": units.tolist(), "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
    for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if drawn[row, 2] or begin == end:
            form, sizes, made = "plain", (None, None), text[begin:end]
        else:
            a, b = int(cuts[row]), int(cuts[len(units) + row])
            sizes = int(low[row]), int(high[row] - low[row])
            head, mid, tail = text[begin:a], text[a:b], text[b:end]
            form = "spm" if drawn[row, 3] % 100 < spm_below else "psm"
            made = s + tail + p + head + m + mid if form == "spm" else p + head + s + tail + m + mid
        out["form"].append(form)
        out["prefix_chars"].append(sizes[0])
        out["middle_chars"].append(sizes[1])
        out["output"].append(made)
    return out


def _transform(carry: int, spm_below: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.stack([np.asarray(c, np.int64) for c in batch.columns[carry + 1:]], axis=1)
            for begin, end, raw, offsets in slices(batch.column(carry)):
                made = _rearranged(raw, offsets, drawn[begin:end], spm_below)
                kept = [batch.column(i).slice(begin, end - begin) for i in range(carry)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(made["n"], pa.int64()), pa.array(made["form"], pa.string()),
                     pa.array(made["prefix_chars"], pa.int64()), pa.array(made["middle_chars"], pa.int64()),
                     pa.array(made["output"], pa.binary()).view(pa.string())],
                    [*batch.schema.names[:carry], "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def rearrange(docs: DataFrame, seed: str = "1", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
              carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n (code points), form, prefix_chars, middle_chars (null if plain) and output."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = draws(F.col("doc_id"), seed)
    plain = text.rlike(MARKS) | (F.get(h, 2) % 100 >= plain_from)
    rows = docs.select(*carry, text.alias("_text"), F.get(h, 0).alias("_one"), F.get(h, 1).alias("_two"),
                       plain.cast("long").alias("_plain"), F.get(h, 3).alias("_form"))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(_transform(len(carry), spm_below), f"{kept}, {SHAPE}")


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from. Rearranged texts hold no marks, so cutting at marks gives their parts."""
    parts = F.split(output, MARKS)
    return (F.when(form == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2)))
            .when(form == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))).otherwise(output))
