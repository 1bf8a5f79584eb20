"""File sources and sinks (S06-S18): CSV with BOM and line breaks in cells, globs, JSON, GEXF, report tables, BibTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wordloom.storage import exists


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """One file or a glob; quotes are doubled, cells may hold line breaks, the word ``null`` is a value, a BOM is dropped."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").option("enforceSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key isn't there yet, so that a second run adds nothing."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.select(sorted(df.columns)).write.mode("append").parquet(path)


def merge_json_state(rows: DataFrame, key: str, state: Column, fields: list[str]) -> DataFrame:
    """Add ``fields`` from a JSON object of string arrays or strings; arrays are joined by ``|``."""
    parsed = F.from_json(state, "map<string,string>")
    cell = lambda f: F.when(parsed[f].startswith("["), F.array_join(F.from_json(parsed[f], "array<string>"), "|")).otherwise(parsed[f])
    return rows.withColumns({f: cell(f) for f in fields})


def write_graph(edges: DataFrame, path: str, by: str | None = None) -> None:
    """Edges and nodes with their degree as parquet below ``path``, of any size; ``by`` a column of the edges (type, anchor) parts both."""
    cols = [by] if by else []
    ends = edges.select(*cols, F.explode(F.array("src", "dst")).alias("id")).groupBy(*cols, "id").agg(F.count(F.lit(1)).alias("degree"))
    for df, name in ((edges, "edges"), (ends, "nodes")):
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{path}/{name}")


def write_gexf(edges: DataFrame, path: str, by: str | None = None) -> list[str]:
    """GEXF text files of src, dst, weight in the local folder or file ``path``: one, or one for each value of ``by``.

    Rows are fetched a partition at a time and written as they come, so a graph of any size is written and the driver holds only
    the names of its nodes; ``write_graph`` is the sink for graphs that no program on one machine would open.
    """
    import os
    from xml.sax.saxutils import quoteattr

    if by:
        os.makedirs(path, exist_ok=True)
        values = sorted(str(r[0]) for r in edges.select(by).where(F.col(by).isNotNull()).distinct().collect())
        return [write_gexf(edges.where(F.col(by).cast("string") == v), os.path.join(path, f"{v}.gexf".replace("/", "_")))[0] for v in values]
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().orderBy("id")
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>\n')
        f.writelines(f"<node id={quoteattr(r['id'])} label={quoteattr(r['id'])}/>\n" for r in nodes.toLocalIterator())
        f.write("</nodes><edges>\n")
        f.writelines(f'<edge id="{i}" source={quoteattr(r["src"])} target={quoteattr(r["dst"])} weight="{r["weight"]}"/>\n' for i, r in enumerate(edges.toLocalIterator()))
        f.write("</edges></graph></gexf>\n")
    return [path]


def report_table(df: DataFrame, style: str = "markdown", max_rows: int = 2_000) -> str:
    """A small result as a Markdown or LaTeX table."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    if style == "markdown":
        line = lambda r: "| " + " | ".join(x.replace("|", "\\|") for x in r) + " |"
        return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *map(line, cells)])
    tex = lambda x: "".join("\\" + c if c in "_%&#$" else c for c in x)
    line = lambda r: " & ".join(map(tex, r)) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", line(df.columns), r"\midrule", *map(line, cells), r"\bottomrule", r"\end{tabular}"])


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """key, kind, fields (map) of every entry of a BibTeX file."""
    raw = spark.read.text(path, wholetext=True)
    entry = r"(?s)@\w+\s*\{[^@]*\}"
    e = raw.select(F.explode(F.regexp_extract_all("value", F.lit(entry), F.lit(0))).alias("e"))
    pairs = F.regexp_extract_all("e", F.lit(r"(\w+)\s*=\s*[\{\"]((?:[^{}\"]|\{[^{}]*\})*)[\}\"]"), F.lit(0))
    name, value = (lambda x: F.lower(F.regexp_extract(x, r"^(\w+)", 1))), (lambda x: F.regexp_extract(x, r"(?s)=\s*[\{\"](.*)[\}\"]$", 1))
    return e.select(F.regexp_extract("e", r"\{\s*([^,\s]+)", 1).alias("key"), F.lower(F.regexp_extract("e", r"@(\w+)", 1)).alias("kind"), F.map_from_arrays(F.array_distinct(F.transform(pairs, name)), F.transform(pairs, value)).alias("fields"))


def _initials(given: str) -> str:
    return " ".join(f"{w[0]}." for w in given.replace("-", " ").split() if w)


def _author(name: str) -> str:
    """``Family, I. I.`` from either order; a name in braces is a group and stays."""
    name = name.strip()
    if name.startswith("{") and name.endswith("}"):
        return name.strip("{}")
    name = name.replace("{", "").replace("}", "")
    family, comma, given = name.partition(",")
    if not comma:
        *first, family = name.split() or [""]
        given = " ".join(first)
    return f"{family.strip()}, {_initials(given)}".rstrip(", ").strip() if given.strip() else family.strip()


def reference_line(kind: str, fields: dict[str, str]) -> str:
    """One entry as a reference line: authors (year). title. where. link; what an entry lacks is left out, a missing year is ``n.d.``."""
    names = [_author(a) for a in fields.get("author", fields.get("editor", "")).replace("\n", " ").split(" and ") if a.strip()]
    who = names[0] if len(names) == 1 else ", ".join(names[:-1]) + f", & {names[-1]}" if names else ""
    plain = lambda x: " ".join(fields.get(x, "").replace("{", "").replace("}", "").split())
    where = plain("journal") or plain("booktitle") or plain("publisher") or plain("howpublished")
    if plain("volume"):
        where += f", {plain('volume')}" + (f"({plain('number')})" if plain("number") else "")
    if plain("pages"):
        where += f", {plain('pages').replace('--', '–')}"
    link = f"https://doi.org/{plain('doi')}" if plain("doi") else plain("url")
    head = f"{who} ({plain('year') or 'n.d.'})." if who else f"({plain('year') or 'n.d.'})."
    return " ".join(x for x in (head, f"{plain('title')}." if plain("title") else "", f"{where}." if where else "", link) if x)


def references(bib: DataFrame, cited: list[str] | None = None, max_rows: int = 20_000) -> list[str]:
    """The lines of the cited entries (all with None), in order of the first author without braces, then the year."""
    rows = (bib if cited is None else bib.where(F.col("key").isin(cited))).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a list of references has at most {max_rows} entries")
    order = lambda r: ((r["fields"].get("author") or "").replace("{", "").lower(), r["fields"].get("year") or "", r["key"])
    return [reference_line(r["kind"], r["fields"]) for r in sorted(rows, key=order)]
