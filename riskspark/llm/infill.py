"""Fill-in-middle transformation: cuts are found through a sparse index of checkpoints over each text.

A text's units are its words, each with the white space before it, and the white space at its end. While the units of a
text are counted, the byte and code-point offsets after every STRIDE units go into its index: a row of three short
arrays, one entry per STRIDE units. A cut after u units is found by a binary search of the index for the last checkpoint
at or before u and a scan of the fewer than STRIDE units from there, so no list of all units is made, and a text of any
length is read once, and its middle not again. The units are separated by ASCII characters, so that bytes are scanned;
code points are bytes that continue none.

The two cuts, whether a text is transformed, and into which order, follow from a hash of seed and doc_id alone. In the
form psm the output is prefix, suffix, middle, each behind its mark; in spm the suffix comes first. A text that holds a
mark stays plain, so restored() gets every text back exactly from output and form.

Defined results: a null text is an empty one; an empty text is plain and has no units; a text of white space is one unit;
a text of any length is one row that its task holds whole; a null doc_id is hashed as the word null; repeated rows get
equal results; an empty table gives an empty one. Other columns are carried, whatever their names, by with_infill(),
which refuses only a name for its own column that is taken.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIDE = 64
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
KIND = "n long, form string, prefix_chars long, middle_chars long, output string"

_CONTINUE = bytes(range(0x80, 0xC0))
_UNIT = rb"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
_ONE = re.compile(_UNIT)


def code_points(data: bytes) -> int:
    return len(data.translate(None, _CONTINUE))


class Checkpoints:
    """The index of one UTF-8 text: units, bytes and code points at every STRIDE-th unit; n counts all units."""

    def __init__(self, data: bytes, stride: int = STRIDE):
        self.data, self.units, self.at, self.points = data, [0], [0], [0]
        run = re.compile(b"(?:%b){%d}" % (_UNIT, stride))
        while m := run.match(data, self.at[-1]):
            self.points.append(self.points[-1] + code_points(m.group()))
            self.units.append(self.units[-1] + stride)
            self.at.append(m.end())
        self.n, at = self.units[-1], self.at[-1]
        for m in _ONE.finditer(data, at):
            self.n, at = self.n + 1, m.end()
        self.words, self.n = self.n, self.n + (at < len(data))  # white space at the end is a unit

    def cut(self, u: int) -> tuple[int, int]:
        """(bytes, code points) before unit u, for 0 <= u <= n."""
        k = bisect_right(self.units, u) - 1
        at, left = self.at[k], u - self.units[k]
        if u > self.words:
            return len(self.data), self.points[k] + code_points(self.data[at:])
        end = re.compile(b"(?:%b){%d}" % (_UNIT, left)).match(self.data, at).end()
        return end, self.points[k] + code_points(self.data[at:end])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(doc_id: int | None, data: bytes, seed: int = 42, rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS) -> tuple:
    """(n, form, prefix_chars, middle_chars, output): rate percent of the texts are transformed, spm percent of those suffix first."""
    index, (h1, h2, h3, h4) = Checkpoints(data), draws(doc_id, seed)
    p, s, m = (x.encode() for x in marks)
    if not data or h3 % 100 >= rate or any(x in data for x in (p, s, m)):
        return index.n, "plain", None, None, data
    first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, before), (b, upto) = index.cut(first), index.cut(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    form = "spm" if h4 % 100 < spm else "psm"
    output = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
    return index.n, form, before, upto - before, output


def with_infill(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "infill", **options) -> DataFrame:
    """docs with one more column, a struct of KIND; options are those of transform()."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already: name another with into")

    @F.arrow_udf(KIND)
    def of(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [transform(i.as_py(), t.as_py() or b"", **options) for i, t in zip(ids, texts, strict=True)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        arrays[4] = arrays[4].view(pa.string())  # bytes that are no UTF-8 stay as they are
        return pa.StructArray.from_arrays(arrays, ["n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.withColumn(into, of(F.col(doc_id).cast("long"), F.col(text).cast("binary")))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, from output and form alone; Spark's own functions."""
    quoted = "|".join(f"\\Q{m}\\E" for m in marks)
    parts = F.split(output, quoted, -1)
    part = lambda k: F.get(parts, k)
    prefix, suffix = F.when(form == "spm", part(2)).otherwise(part(1)), F.when(form == "spm", part(1)).otherwise(part(2))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part(3), suffix))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    d = with_infill(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    x = d.select("doc_id", "infill.*")
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_W = "\\x20\\x09-\\x0D"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[{_W}]*[^{_W}]+|[{_W}]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
x AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, {", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS pre, array_to_string(list_slice(u, a + 1, b), '') AS mid, array_to_string(list_slice(u, b + 1, n), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
