"""GEDCOM files as graphs of people, events, relationships and sources: lines in a table, records by windows, nodes and edges by joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.graph import Graph
from evigraph.operators.loops import numbered, settle

# Kinds of nodes, and event tags with their names.
PERSON, EVENT, RELATIONSHIP, SOURCE = "person_candidate", "event_claim", "relationship_claim", "source_record"
EVENT_TAGS = {
    "BIRT": "birth", "CHR": "christening", "DEAT": "death", "BURI": "burial", "MARR": "marriage", "DIV": "divorce", "RESI": "residence", "OCCU": "occupation", "EMIG": "emigration", "IMMI": "immigration",
    "CENS": "census", "EDUC": "education", "EVEN": "event",
}
STATUS = "imported_unreviewed"


#: Lines of a file that are looked at together; what they leave open is settled over all blocks of the file.
BLOCK_LINES = 50_000
_NEAR = "file string, line_no long, level int, parent long, root long, last boolean"


def _nearest(group: pa.Table) -> pa.Table:
    """Lines of one file or more with the nearest line before that has a smaller level, and the last line of level 0 up to each; last: no later line hides it."""
    group = group.select(["file", "line_no", "level"]).sort_by([("file", "ascending"), ("line_no", "ascending")])
    files, numbers, levels = (group.column(c).to_pylist() for c in ("file", "line_no", "level"))
    stack: list[int] = []
    parent, root, zero = [], [], None
    open_to_view: set[int] = set()
    for i, level in enumerate(levels):
        if i and files[i] != files[i - 1]:
            open_to_view.update(stack)
            stack, zero = [], None
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        parent.append(numbers[stack[-1]] if stack else None)
        zero = numbers[i] if level == 0 else zero
        root.append(zero)
        stack.append(i)
    open_to_view.update(stack)
    for name, values, kind in (("parent", parent, pa.int64()), ("root", root, pa.int64()), ("last", [i in open_to_view for i in range(len(levels))], pa.bool_())):
        group = group.append_column(name, pa.array(values, kind))
    return group


def with_parents(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """lines (file, line_no, level, ...) with parent and root: all nearest smaller levels, in blocks.

    Files are packed together, so that a task's call sees about as many lines as a block has, however small they are. A block settles most of its lines by itself. The rest look for a line of an earlier block, and only those lines of a block can be it that no later line of the
    block hides: so the same pass over these and the open lines alone, a small part of a file, settles the rest.
    """
    block = F.floor(F.col("line_no") / block_lines)
    pack = F.pmod(F.xxhash64("file"), F.lit(lines.count() // block_lines + 1))
    near = settle(lines.select("file", F.col("line_no").cast("long").alias("line_no"), "level", block.alias("block"), pack.alias("pack")).groupBy("pack", "block").applyInArrow(_nearest, _NEAR))
    several = near.groupBy("file").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b")).where(F.floor(F.col("a") / block_lines) < F.floor(F.col("b") / block_lines)).select("file")
    open_ = (F.col("parent").isNull() & (F.col("level") > 0)) | F.col("root").isNull()
    rest = near.where(open_ | F.col("last")).join(several, "file", "left_semi").select("file", "line_no", "level")
    found = rest.groupBy("file").applyInArrow(_nearest, _NEAR).select("file", "line_no", F.col("parent").alias("far"), F.col("root").alias("far_root"))
    known = near.join(found, ["file", "line_no"], "left").select("file", "line_no", F.when(F.col("level") > 0, F.coalesce("parent", "far")).alias("parent"), F.coalesce("root", "far_root").alias("root"))
    return lines.join(known, ["file", "line_no"])


def parsed_lines(texts: DataFrame) -> DataFrame:
    """texts: (file, value), a file a row. Returns (file, line_no, level, xref, tag, value, parent, root): parent and root are line numbers."""
    return _parsed(texts.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "raw")))


def _parsed(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, raw) with their parts, parent and root.

    The parent is the nearest line before with a smaller level, levels being of any depth. Blank lines are skipped; a line without a level raises.
    """
    lines = lines.where(F.trim("raw") != "").withColumn("raw", F.trim("raw"))
    bad = F.raise_error(F.concat(F.lit("invalid GEDCOM line: "), F.col("raw")))
    level = F.when(F.col("raw").rlike(r"^\d+( |$)"), F.regexp_extract("raw", r"^(\d+)", 1).cast("int")).otherwise(bad.cast("int"))
    rest = F.regexp_replace("raw", r"^\d+ ?", "")
    xref = F.regexp_extract(rest, r"^(@[^ ]*@)( |$)", 1)
    body = F.when(xref != "", F.regexp_replace(rest, r"^@[^ ]*@ ?", "")).otherwise(rest)
    return with_parents(lines.select("file", "line_no", level.alias("level"), xref.alias("xref"), F.regexp_extract(body, r"^([^ ]*)", 1).alias("tag"), F.regexp_replace(body, r"^[^ ]* ?", "").alias("value")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """parsed_lines of files of any size: a file is read in splits by many tasks, and its lines are numbered by where their split begins and their place in it."""
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("raw"))
    every = numbered(read, ["file", "split", "place"], "n")
    first = every.groupBy("file").agg(F.min("n").alias("first"))
    return _parsed(every.join(first, "file").select("file", (F.col("n") - F.col("first")).alias("line_no"), F.regexp_replace("raw", "\r$", "").alias("raw")))


def _clean(xref: Column) -> Column:
    return F.trim(F.trim(xref), F.lit("@"))


def graph_of(lines: DataFrame, graph_id: str) -> Graph:
    """People, sources, events of people and relationships of families, with their edges; every record stays an unreviewed claim.

    Events are numbered within a person, event tags only. Source edges go to known sources only; participant edges may lack their person.
    """
    g = F.lit(graph_id)
    child = lines.select("file", F.col("parent").alias("line_no"), F.col("tag").alias("c_tag"), F.col("value").alias("c_value"), F.col("line_no").alias("c_no"))
    first = lambda tag: F.min_by(F.when(F.col("c_tag") == tag, F.col("c_value")), F.when(F.col("c_tag") == tag, F.col("c_no")))
    details = child.groupBy("file", "line_no").agg(*[F.coalesce(first(t), F.lit("")).alias(t.lower()) for t in ("NAME", "SEX", "TITL", "AUTH", "DATE", "PLAC")])
    rows = settle(lines.join(details, ["file", "line_no"], "left").fillna("", ["name", "sex", "titl", "auth", "date", "plac"]))  # read by every kind of node and edge
    roots = rows.where("level = 0")
    json = lambda **kv: F.to_json(F.struct(*[v.alias(k) for k, v in kv.items()]))
    node = lambda df, ident, kind, title, meta, aliases=F.array().cast("array<string>"): df.select(ident.alias("id"), F.lit(kind).alias("type"), title.alias("title"), aliases.alias("aliases"), F.lit(STATUS).alias("status"), meta.alias("metadata"))

    people, sources = roots.where("tag = 'INDI' AND xref != ''"), roots.where("tag = 'SOUR' AND xref != ''")
    shown = F.trim(F.regexp_replace(F.replace("name", F.lit("/"), F.lit("")), r"\s+", " "))
    title = F.when(shown != "", shown).otherwise(F.col("xref"))
    person_id = lambda x: text.node_id(PERSON, g, _clean(x))
    source_id = lambda x: text.node_id(SOURCE, g, _clean(x))
    alias = F.when((F.col("name") != "") & (F.col("name") != title), F.array("name")).otherwise(F.array().cast("array<string>"))
    nodes = node(people, person_id(F.col("xref")), PERSON, title, json(gedcom_xref=F.col("xref"), sex=F.col("sex"), publication_status=F.lit("private_unreviewed")), alias)
    s_title = F.when(F.col("titl") != "", F.col("titl")).when(F.col("value") != "", F.col("value")).otherwise(F.col("xref"))
    nodes = nodes.unionByName(node(sources, source_id(F.col("xref")), SOURCE, s_title, json(gedcom_xref=F.col("xref"), author=F.col("auth"))))

    owner = people.select("file", F.col("line_no").alias("parent"), F.col("xref").alias("owner"))
    events = rows.where(F.col("tag").isin(*EVENT_TAGS)).join(owner, ["file", "parent"]).withColumn("n", F.row_number().over(Window.partitionBy("file", "parent").orderBy("line_no")))
    names = F.create_map(*[F.lit(x) for kv in EVENT_TAGS.items() for x in kv])
    kind = names[F.col("tag")]
    event_id = text.node_id(EVENT, g, _clean(F.col("owner")), F.lower("tag"), F.col("n").cast("string"))
    e_title = F.concat_ws(" - ", kind, F.nullif("date", F.lit("")), F.nullif("plac", F.lit("")))
    nodes = nodes.unionByName(node(events, event_id, EVENT, e_title, json(gedcom_tag=F.col("tag"), event_kind=kind, date=F.col("date"), place=F.col("plac"), raw_value=F.col("value"), publication_status=F.lit("private_unreviewed"))))

    edge = lambda df, ident, a, b, kind, meta=F.lit("{}"): df.select(ident.alias("id"), a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), F.lit(STATUS).alias("status"), meta.alias("metadata"))
    about = events.withColumns({"e": event_id, "p": person_id(F.col("owner"))})
    edges = edge(about, text.node_id("edge", F.col("e"), F.lit("about"), F.col("p")), F.col("e"), F.col("p"), "about_person")
    cited = rows.where("tag = 'SOUR' AND level > 0").withColumn("n", F.row_number().over(Window.partitionBy("file", "parent").orderBy("line_no"))).withColumn("s", source_id(F.col("value")))
    holders = about.select("file", F.col("line_no").alias("parent"), F.col("e").alias("t")).unionByName(people.select("file", F.col("line_no").alias("parent"), person_id(F.col("xref")).alias("t")))
    known = sources.select(source_id(F.col("xref")).alias("s")).distinct()
    support = cited.join(holders, ["file", "parent"]).join(known, "s", "left_semi")
    edges = edges.unionByName(edge(support, text.node_id("edge", F.col("s"), F.lit("supports"), F.col("t"), F.col("n").cast("string")), F.col("s"), F.col("t"), "supports"))

    family = roots.where("tag = 'FAM'").select("file", F.col("line_no").alias("parent"), F.col("xref").alias("fam"))
    members = rows.where("tag IN ('HUSB', 'WIFE', 'CHIL')").join(family, ["file", "parent"]).select("file", "parent", "fam", "tag", "value")
    side = lambda tags, name: members.where(F.col("tag").isin(*tags)).select("file", "parent", "fam", F.col("value").alias(name))
    spouses = side(("HUSB",), "a").join(side(("WIFE",), "b"), ["file", "parent", "fam"]).withColumns({"rel": F.lit("spouse"), "ra": F.lit("spouse"), "rb": F.lit("spouse")})
    parents = side(("HUSB", "WIFE"), "a").join(side(("CHIL",), "b"), ["file", "parent", "fam"]).withColumns({"rel": F.lit("parent-child"), "ra": F.lit("parent"), "rb": F.lit("child")})
    both = spouses.unionByName(parents).withColumn("r", text.node_id(RELATIONSHIP, g, _clean(F.col("fam")), F.col("rel"), _clean(F.col("a")), _clean(F.col("b"))))
    nodes = nodes.unionByName(node(both, F.col("r"), RELATIONSHIP, F.concat("rel", F.lit(" relationship")), json(gedcom_xref=F.col("fam"), relationship_kind=F.replace("rel", F.lit("-"), F.lit("_")))))
    for who, role in (("a", "ra"), ("b", "rb")):
        p = person_id(F.col(who))
        edges = edges.unionByName(edge(both, text.node_id("edge", F.col("r"), F.col(role), p), F.col("r"), p, "relationship_participant", F.to_json(F.struct(F.col(role).alias("role")))))
    header = lines.sparkSession.createDataFrame([(graph_id, f"Genealogy graph {graph_id}", '{"domain":"genealogy","source_format":"GEDCOM"}')], "graph_id string, title string, metadata string")
    return Graph(nodes.withColumn("pos", F.col("id")), edges.withColumn("pos", F.col("id")), header)


def read_gedcom(spark: SparkSession, path: str, graph_id: str) -> Graph:
    return graph_of(read_lines(spark, path), graph_id)
