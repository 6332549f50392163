"""Scored windows as text: the report of a window, the table of hits and loci, both ways."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record begins with so many marks and two blanks before the program's name.
RULE = "#" * 28 + "  "

#: The report's labels of each field, and how it is written.
FIELDS = [
    ("n", "Sequences", "%d", "int"), ("columns", "Columns", "%d", "int"), ("direction", "Reading direction", "%s", "string"),
    ("identity", "Mean pairwise identity", "%6.2f", "double"), ("entropy", "Shannon entropy", "%2.5f", "double"), ("gc", "G+C content", "%2.5f", "double"),
    ("mean_mfe", "Mean single sequence MFE", "%6.2f", "double"), ("consensus_mfe", "Consensus MFE", "%6.2f", "double"),
    ("energy", "Energy contribution", "%6.2f", "double"), ("covariance", "Covariance contribution", "%6.2f", "double"),
    ("comb_per_pair", "Combinations/Pair", "%6.2f", "double"), ("z", "Mean z-score", "%6.2f", "double"),
    ("sci", "Structure conservation index", "%6.2f", "double"), ("background", "Background model", "%s", "string"),
    ("decision", "Decision model", "%s", "string"), ("dec_value", "SVM decision value", "%6.2f", "double"),
    ("p", "SVM RNA-class probability", "%6f", "double"), ("prediction", "Prediction", "%s", "string"),
]
#: The columns of hit and locus lines.
HIT_COLUMNS = {
    "window_id": "windowID", "locus_id": "clusterID", "seq_id": "seqID", "start": "start", "end": "end", "strand": "strand", "n": "N",
    "columns": "columns", "identity": "identity", "mean_mfe": "meanMFE", "consensus_mfe": "consensusMFE", "energy": "energyTerm",
    "covariance": "covarianceTerm", "comb_per_pair": "combPerPair", "z": "z", "sci": "SCI", "dec_value": "decValue", "p": "P", "gc": "GC",
}
LOCUS_COLUMNS = {
    "locus_id": "locusID", "seq_id": "seqID", "start": "start", "end": "end", "max_n": "maxN", "max_identity": "maxIdentity", "max_p": "maxP", "min_z": "minZ",
}
_TEXT = ("window_id", "locus_id", "seq_id", "strand")
_LONG = ("start", "end", "n", "columns", "max_n")
REPORT_ROW = "struct<name:string,start:bigint,end:bigint,strand:string,full_length:bigint,seq:string,fold:string,mfe:double,z:double,method:string>"


def bound(value: Column, told: Callable[[Column], Column]) -> Column:
    """``told`` of ``value``, which is evaluated once however often ``told`` names it."""
    return F.get(F.transform(F.array(value), told), F.lit(0))


def _shown(form: str, x: Column) -> Column:
    """``format_string``, spared where a decimal or the text alone says the same: a formatter costs several times as much."""
    if form[-1] != "f":
        return F.coalesce(x.cast("string"), F.lit("null"))
    width, places = (int(n) if n else d for n, d in zip((form[1:-1].split(".") + [""])[:2], (0, 6)))
    # not so: null, NaN, the infinities, large numbers, and the zeros that keep a sign
    plain = (F.abs(x) < 1e9) & ((x > 0) | (x <= -(10.0 ** -places)))
    text = x.try_cast(f"decimal({places + 10},{places})").cast("string")
    padded = text
    if width > places + 2:  # else the text is as long as that already; short ones, the usual, are written once
        padded = F.when(F.abs(x) < 10.0 ** (width - places - 2) - 1, F.lpad(text, width, " ")).when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)
    return F.when(plain, padded).otherwise(F.format_string(form, x))


def report_text(program: str = "screen 1.0") -> Column:
    """A report of a row with the columns of FIELDS, ``rows`` (see REPORT_ROW), ``consensus`` and ``structure``.

    Numbers are rounded half up; a row without ``full_length`` has no position.
    """
    lines = [F.concat(F.lit(f" {label}: "), _shown(form, F.col(name))) for name, label, form, _ in FIELDS]

    def row(r: Column) -> Column:
        head = F.when(r["full_length"].isNull(), F.concat(F.lit(">"), r["name"])).otherwise(F.concat(
            F.lit(">"), F.concat_ws(" ", r["name"], r["start"], r["end"] - r["start"], r["strand"], r["full_length"])))
        tail = F.concat(_shown("%s", r["fold"]), F.lit(" ( "), _shown("%6.2f", r["mfe"]), F.lit(", z-score = "), _shown("%6.2f", r["z"]), F.lit(", "), _shown("%s", r["method"]), F.lit(")"))
        return F.concat_ws("\n", head, r["seq"], tail)

    shown = {c: _shown("%6.2f", F.col(c)) for c in ("consensus_mfe", "energy", "covariance")}
    last = F.concat_ws("\n", F.lit(">consensus"), "consensus", F.concat(
        _shown("%s", F.col("structure")), F.lit(" ("), shown["consensus_mfe"], F.lit(" = "), shown["energy"], F.lit(" + "), shown["covariance"], F.lit(")")))
    return F.concat(F.lit(f"\n{RULE}{program}  {'#' * 30}\n\n"), F.concat_ws("\n", *lines), F.lit(f"\n\n{'#' * 70}\n\n"),
                    F.array_join(F.transform("rows", row), "\n"), F.lit("\n"), last, F.lit("\n"))


#: Parts what one expression finds; a text that holds it is searched field by field.
MARK = "\x01"
_VALUES = {"int": r"(\d+)", "double": r"(-?\d+\.?\d*)", "string": r"([^\s>](?:[^\n>]*[^\s>])?)"}
#: The fields of a report as it is written, all in order, and what is behind them.  No field's label or row can be elsewhere before that.
_HEAD = r"\A\n?[^\n:>]*\n\n" + "".join(
    r" *" + "".join("\\" + c if c in "+/()" else c for c in label) + ": *" + _VALUES[kind] + r"\n" for _, label, _, kind in FIELDS) + r"(?s:(.*))\z"
#: A row as it is written: name, start, length, strand, size, sequence, third line, energy, score, method.
_ROW = r"\A>([\w.|-]+) (\d+) (\d+) ([+-]) (\d+)\n(\w[\w-]*)\n([.()-]+ \( *(-?\d+\.\d+), z-score = *(-?\d+\.\d+), ([RS])\))\z"


def _groups(text: Column, pattern: str, n: int) -> Column:
    """What the ``n`` groups of a pattern of the whole text hold, behind an empty text; other texts give one piece."""
    parted = F.regexp_replace(text, pattern, MARK + MARK.join(f"${i}" for i in range(1, n + 1)))
    return F.when(~text.contains(MARK), F.split(parted, MARK, n + 1))


def parse_report(record: Column) -> Column:
    """The fields of one report as a struct; what the text lacks is null.

    Rows come in two forms: ``>name start length strand size``, or
    ``>name/start-end``, whose strand is the reading direction.

    A report in the form that is written is read by one expression, and so is
    a row; others are searched for each field.
    """
    n = len(FIELDS)

    def told(parts: Column) -> Column:
        quick = [F.get(parts, F.lit(i)).cast(kind) for i, (*_, kind) in enumerate(FIELDS, 1)]
        return F.when(F.size(parts) == n + 2, _report(quick, F.get(parts, F.lit(n + 1)))).otherwise(_report([_searched(record, label, kind) for _, label, _, kind in FIELDS], record))

    return bound(_groups(record, _HEAD, n + 1), told)


def _searched(record: Column, label: str, kind: str) -> Column:
    form = {"int": r"(\d+)", "double": r"(-?\d+\.?\d*)", "string": r"(\S[^\n]*?)\s*(?:\n|$)"}[kind]
    escaped = "".join("\\" + c if c in "+/()" else c for c in label)
    return F.nullif(F.regexp_extract(record, rf"(?:^|\n)\s*{escaped}:\s*{form}", 1), F.lit("")).cast(kind)


def _report(fields: list[Column], rest: Column) -> Column:
    """A report's struct, of its fields and the text that holds its rows."""
    read = fields[[name for name, *_ in FIELDS].index("direction")]
    direction = F.when(read == "forward", "+").when(read == "reverse", "-")
    found = F.regexp_extract_all(rest, F.lit(r"(>[^\n]+\n[^\n]+\n[^\n]+)"), F.lit(1))

    def got(x: Column, pattern: str, i: int = 1) -> Column:
        return F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))

    def row(x: Column) -> Column:
        long, short = r"^>(.*?) (\d+) (\d+) ([+-]) (\d+)", r"^>(.*)/(\d+)-(\d+)\n"
        seq = got(x, r"^[^\n]+\n([^\n]+)")
        start = F.coalesce(got(x, long, 2), got(x, short, 2)).cast("long")
        return F.struct(
            F.coalesce(got(x, long), got(x, short), got(x, r"^>([^\n]+)")).alias("name"), start.alias("start"),
            F.coalesce(start + got(x, long, 3).cast("long"), got(x, short, 3).cast("long")).alias("end"),
            F.coalesce(got(x, long, 4), direction).alias("strand"), got(x, long, 5).cast("long").alias("full_length"), seq.alias("seq"),
            F.substring(got(x, r"^[^\n]+\n[^\n]+\n([^\n]+)"), F.lit(1), F.length(seq)).alias("fold"),
            got(x, r"\(\s*(-?\d+\.\d+), z-score").cast("double").alias("mfe"), got(x, r"z-score =\s*(-?\d+\.\d+)").cast("double").alias("z"),
            got(x, r", ([RS])\)").alias("method"))

    def written(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i))
        start = at(2).cast("long")
        return F.struct(
            at(1).alias("name"), start.alias("start"), (start + at(3).cast("long")).alias("end"), at(4).alias("strand"), at(5).cast("long").alias("full_length"), at(6).alias("seq"),
            F.substring(at(7), F.lit(1), F.length(at(6))).alias("fold"), at(8).cast("double").alias("mfe"), at(9).cast("double").alias("z"), at(10).alias("method"))

    def rows_of(all_: Column) -> Column:
        own = F.transform(F.filter(all_, lambda x: ~x.startswith(">consensus")), lambda x: bound(
            _groups(x, _ROW, 10), lambda p: F.when(F.size(p) == 11, written(p)).otherwise(row(x))))
        consensus = F.get(F.filter(all_, lambda x: x.startswith(">consensus")), F.lit(0))
        return F.struct(*[c.alias(name) for c, (name, *_) in zip(fields, FIELDS)], direction.alias("strand"), own.alias("rows"),
                        got(consensus, r"^[^\n]+\n([^\n]+)").alias("consensus"), got(consensus, r"\n([.()]+)[^\n]*$").alias("structure"))

    return bound(found, rows_of)


def read_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per report: its fields, and ``seq_id, start, end`` of the first row."""
    text = spark.read.text(path, lineSep=RULE).where(F.col("value").contains("Sequences:"))
    got = text.select(parse_report(F.col("value")).alias("r")).select("r.*")
    ref = F.get("rows", F.lit(0))
    return got.withColumn("seq_id", ref["name"]).withColumn("start", ref["start"]).withColumn("end", ref["end"])


def hit_line() -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in HIT_COLUMNS])


def locus_line() -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in LOCUS_COLUMNS])


def screen_lines(hits: DataFrame, loci: DataFrame, *, header: bool = False) -> DataFrame:
    """Loci, each before its windows, as lines of text in order: ``value``.

    ``hits`` has HIT_COLUMNS, ``loci`` LOCUS_COLUMNS.  The order is by
    sequence, locus and start.
    """
    heads = loci.select("seq_id", F.col("start").alias("_at"), "locus_id", F.lit(0).alias("_kind"), F.col("start").alias("_start"), locus_line().alias("value"))
    at = loci.select("locus_id", F.col("start").alias("_at"))
    rows = hits.join(at, "locus_id").select("seq_id", "_at", "locus_id", F.lit(1).alias("_kind"), F.col("start").alias("_start"), hit_line().alias("value"))
    lines = heads.unionByName(rows).orderBy("seq_id", "_at", "locus_id", "_kind", "_start", "value").select("value")
    if not header:
        return lines
    names = [(f"# {chr(9).join(c.values())}",) for c in (LOCUS_COLUMNS, HIT_COLUMNS)]
    return hits.sparkSession.createDataFrame(names, "value string").union(lines)


def read_screen(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Hits and loci of such lines, told apart by their first word; comments go."""
    text = spark.read.text(path)

    def table(kind: str, columns: dict[str, str]) -> DataFrame:
        cells = F.split("value", "\t", -1)
        made = [F.nullif(F.get(cells, F.lit(i)), F.lit("")).cast("string" if c in _TEXT else "long" if c in _LONG else "double").alias(c) for i, c in enumerate(columns)]
        more = F.when(F.size(cells) > len(columns), F.slice(cells, len(columns) + 1, F.size(cells))).alias("annotations")
        return text.where(F.col("value").rlike(rf"^{kind}\d+\t")).select(*made, more)

    return table("window", HIT_COLUMNS).drop("annotations"), table("locus", LOCUS_COLUMNS)
