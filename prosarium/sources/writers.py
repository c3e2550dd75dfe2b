"""Tables to files, and the texts that are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """K1."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """K2."""
    df.write.mode("overwrite").json(path)


def textgrid(df: DataFrame, keys: list[str], tier: str = "words", order: str = "idx") -> DataFrame:
    """K3: keys and value, the TextGrid of each group's intervals in one tier. Quotes are doubled."""
    num = lambda c: F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("xmin").cast("double").alias("a"), F.col("xmax").cast("double").alias("b"), F.replace(F.coalesce("mark", F.lit("")), F.lit('"'), F.lit('""')).alias("t"))))
    g = df.groupBy(*keys).agg(rows.alias("r"), F.max("xmax").cast("double").alias("end"))
    body = F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("        intervals ["), (i + 1).cast("string"), F.lit("]:\n            xmin = "), x["a"].cast("string"), F.lit("\n            xmax = "), x["b"].cast("string"), F.lit('\n            text = "'), x["t"], F.lit('"\n'))), "")
    end, n = num(F.col("end")), F.size("r").cast("string")
    head = F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = '), end, F.lit(f'\ntiers? <exists>\nsize = 1\nitem []:\n    item [1]:\n        class = "IntervalTier"\n        name = "{tier}"\n        xmin = 0\n        xmax = '), end, F.lit("\n        intervals: size = "), n, F.lit("\n"))
    return g.select(*keys, F.concat(head, body).alias("value"))


def write_text_files(df: DataFrame, path: str, name: str, value: str) -> None:
    """K3, K4: one folder per name with one text file. The files of a folder are written by the tasks, nothing is gathered."""
    df.select(F.col(name).alias("name"), F.col(value).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def numbered_name(number: Column, extension: str = "xml") -> Column:
    """K4: 0001.xml."""
    return F.concat(F.lpad(number.cast("string"), 4, "0"), F.lit("." + extension))


def label_line(start: Column, end: Column, text: Column) -> Column:
    """K5: a label track's line, tab-separated, six decimals."""
    return F.format_string("%.6f\t%.6f\t%s", start.cast("double"), end.cast("double"), text)


def merge_manifest(df: DataFrame, keys: list[str], path: str, number: str) -> DataFrame:
    """What would be merged, in order: keys, place, path. Audio itself is left to providers."""
    from pyspark.sql import Window

    return df.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy(number)) - 1).alias("place"), path)


def copy_manifest(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the left whose partner exists."""
    return left.join(right.select(*on).distinct(), on, "left_semi")


def render(df: DataFrame, style: str = "markdown", most: int = 1000) -> str:
    """K7: a small result as a Markdown, CSV or LaTeX table; more than `most` rows are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them as files")
    cells = [[("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)) for v in r] for r in rows]
    if style == "csv":
        return "\n".join(",".join(r) for r in [df.columns, *cells])
    if style == "latex":
        return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", *[" & ".join(r) + r" \\" for r in [df.columns, *cells]], r"\end{tabular}"])
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *cells])


def render_html(df: DataFrame, title: str = "", most: int = 1000) -> str:
    """K8: the same as an HTML page."""
    import html

    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them as files")
    cell = lambda v, t: f"<{t}>{html.escape('' if v is None else str(v))}</{t}>"
    body = "".join("<tr>" + "".join(cell(v, "td") for v in r) + "</tr>" for r in rows)
    return f"<html><head><title>{html.escape(title)}</title></head><body><table><tr>{''.join(cell(c, 'th') for c in df.columns)}</tr>{body}</table></body></html>"


def html_diff(a: str, b: str, width: int = 80) -> str:
    """Two transcripts side by side, wrapped."""
    import textwrap
    from difflib import HtmlDiff

    return HtmlDiff(wrapcolumn=width).make_table(textwrap.wrap(a, width), textwrap.wrap(b, width))


def cached(df: DataFrame, path: str) -> DataFrame:
    """Df by way of a Parquet folder, which is made if it isn't there. The folder must be shared by all executors."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
