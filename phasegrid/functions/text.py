"""String, JSON and map helpers used around a run."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from phasegrid.functions.numeric import _c


def default_filename(prefix: str, ts, min_channel, channels, fpga_ids) -> Column:
    """``prefix_YYYYmmdd-HHMM_first_last_ALVEOa_ALVEOb`` with the product suffix."""
    first = _c(min_channel)
    last = first + _c(channels) - 1
    tags = F.concat_ws("", F.transform(_c(fpga_ids), lambda f: F.concat(F.lit("_ALVEO"), f.cast("string"))))
    return F.concat(F.lit(prefix + "_"), F.date_format(_c(ts), "yyyyMMdd-HHmm"), F.lit("_"),
                    first.cast("string"), F.lit("_"), last.cast("string"), tags, F.lit(".hdf5"))


def split_names(csv) -> Column:
    """Comma separated names without the empty ones."""
    return F.filter(F.split(_c(csv), ","), lambda s: s != "")


def sidecar_name(path) -> Column:
    """Replace the extension of the last path component by ``.streams.csv``."""
    return F.concat(F.regexp_replace(_c(path), r"\.[^./\\]*$", ""), F.lit(".streams.csv"))


def series_key(prefix, channel, pol, beam, freq) -> Column:
    return F.concat(_c(prefix), F.lit(":ch:"), _c(channel).cast("string"), F.lit(":p:"), _c(pol).cast("string"),
                    F.lit(":b:"), _c(beam).cast("string"), F.lit(":f:"), _c(freq).cast("string"))


def clean_kernel_name(raw) -> Column:
    """The bare function name of a signature, whole: the last name before templates and arguments.

    A signature without such a name (an unnamed operator, say) stays as it is, trimmed.
    """
    name = F.trim(F.regexp_extract(_c(raw), r"([^:<>()]+)(?:<.*>)?\s*(?:\(.*\))?\s*$", 1))
    return F.when(name == "", F.trim(_c(raw))).otherwise(name)


def short_label(name, width: int = 40) -> Column:
    """A name for display: cut to ``width`` with an ellipsis.  Not a key, as cuts may coincide."""
    return F.when(F.length(_c(name)) > width, F.concat(F.substring(_c(name), 1, width - 1), F.lit("…"))).otherwise(_c(name))


def nth_cpu(cpu_list, n) -> Column:
    """n-th entry of a comma separated CPU list, -1 if absent or garbled before it."""
    parts = F.slice(F.split(F.coalesce(_c(cpu_list), F.lit("")), ","), 1, _c(n) + 1)
    good = (F.size(parts) == _c(n) + 1) & F.forall(parts, lambda p: p.rlike(r"^\s*[-+]?\d+$"))
    return F.when(good, F.trim(F.element_at(parts, -1)).cast("int")).otherwise(F.lit(-1))


def bind(value, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_UNIT = r"[%,;xsmunGMKBkHz/]*"
#: A pair between blanks whose key has no later pair with a number.
_PAIR = rf"(?s)(?:^| )([^ =]+)=({_NUMBER}){_UNIT}(?= |$)(?!.* \1={_NUMBER}{_UNIT}(?: |$))"


def key_values(line) -> Column:
    """``key=number`` pairs of a log line as a map; a repeated key keeps the last.

    A pair is a piece between blanks, cut at its first ``=``.  Values that are not a
    number are dropped; a unit after the digits, such as a percent sign, is ignored.
    """
    found = lambda group: F.regexp_extract_all(_c(line), F.lit(_PAIR), F.lit(group))
    return F.map_from_arrays(found(1), found(2).cast("array<double>"))


def json_number(doc, path: str, default) -> Column:
    """Nested JSON number with a default for a missing or unreadable value."""
    return F.coalesce(F.get_json_object(_c(doc), path).try_cast("double"), F.lit(float(default)))


def default_counts(default: int = 1, size: int = 500) -> Column:
    """Map of ids 0..size-1, all carrying the same default."""
    return F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                                          lambda i: F.struct(i, F.lit(default))))


def nested_dims(array, depth: int) -> Column:
    """Extents of a rectangular nested array, outermost first."""
    dims, level = [], _c(array)
    for _ in range(depth):
        dims.append(F.size(level))
        level = level[0]
    return F.array(*dims)
