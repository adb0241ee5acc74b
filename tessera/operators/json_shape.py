"""FOR JSON and FOR XML: rows shaped into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import EngineError


def _tree(columns: dict[str, Column]) -> dict:
    """Dotted names as nested dictionaries; a name that is a value and a parent too is an error."""
    out: dict = {}
    for name, column in columns.items():
        *above, last = name.split(".")
        node = out
        for part in above:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise EngineError(13601, f"property {name} cannot be generated: conflict with another column")
        if last in node:
            raise EngineError(13601, f"property {name} cannot be generated: conflict with another column")
        node[last] = column
    return out


def _struct(tree: dict) -> Column:
    fields = []
    for name, value in tree.items():
        fields.append((_struct(value) if isinstance(value, dict) else value).alias(name))
    return F.struct(*fields)


def row_json(columns: dict[str, Column], include_nulls: bool = False) -> Column:
    """A row's object; nulls are left out unless they are to be included."""
    return F.to_json(_struct(_tree(columns)), {"ignoreNullFields": str(not include_nulls).lower()})


def for_json_path(df: DataFrame, columns: dict[str, Column], order: list[Column], by: list[str] | None = None, include_nulls: bool = False, root: str | None = None, wrapper: bool = True) -> DataFrame:
    """SELECT ... FOR JSON PATH as column json: one document, or one for each group of by."""
    keys = [o.alias(f"o{i}") for i, o in enumerate(order)]
    rows = F.sort_array(F.collect_list(F.struct(*keys, row_json(columns, include_nulls).alias("j"))))
    text = F.array_join(F.transform(rows, lambda r: r["j"]), ",")
    if wrapper:
        text = F.concat(F.lit("["), text, F.lit("]"))
    if root is not None:
        if not wrapper:
            raise EngineError(13620, "ROOT and WITHOUT_ARRAY_WRAPPER cannot be used together")
        text = F.concat(F.lit(f'{{"{root}":'), text, F.lit("}"))
    return (df.groupBy(*by) if by else df.groupBy()).agg(text.alias("json"))


def for_json_auto(df: DataFrame, parents: dict[str, Column], child: str, children: dict[str, Column], order: list[Column], by: list[str]) -> DataFrame:
    """FOR JSON AUTO of two sources as one object for each parent: runs of equal parents, in order, share an array of children.

    by are the columns that bound a document (each distinct value gives one); runs are islands of equal parent values.
    """
    marked = df.select(*by, *[c.alias(f"p_{k}") for k, c in parents.items()], F.struct(*[c.alias(k) for k, c in children.items()]).alias("c"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    w = Window.partitionBy(*by).orderBy(*[f"o{i}" for i in range(len(order))])
    same = F.lit(True)
    for k in parents:
        same = same & F.col(f"p_{k}").eqNullSafe(F.lag(f"p_{k}").over(w))
    marked = marked.withColumn("first", (~same | (F.row_number().over(w) == 1)).cast("int")).withColumn("island", F.sum("first").over(w))
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(f"o{i}") for i in range(len(order))], F.col("c"))))
    grouped = marked.groupBy(*by, "island", *[f"p_{k}" for k in parents]).agg(F.transform(rows, lambda r: r["c"]).alias(child))
    shaped = F.to_json(F.struct(*[F.col(f"p_{k}").alias(k) for k in parents], F.col(child)))
    objects = F.sort_array(F.collect_list(F.struct("island", shaped.alias("j"))))
    return grouped.groupBy(*by).agg(F.concat(F.lit("["), F.array_join(F.transform(objects, lambda r: r["j"]), ","), F.lit("]")).alias("json"))


def xml_escape(x: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if attribute else out


def row_xml(columns: dict[str, Column], element: str = "row") -> Column:
    """A row's element: names with @ are attributes, with / nested; nulls are left out."""
    attributes = [F.when(c.isNotNull(), F.concat(F.lit(f' {n[1:]}="'), xml_escape(c.cast("string"), True), F.lit('"'))).otherwise("") for n, c in columns.items() if n.startswith("@")]

    def body(tree: dict) -> list[Column]:
        out = []
        for name, value in tree.items():
            if isinstance(value, dict):
                inner = F.concat(*body(value))
                out.append(F.when(inner != "", F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))).otherwise(""))
            else:
                text = xml_escape(value.cast("string"))
                out.append(F.coalesce(text if name == "text()" else F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>")), F.lit("")))
        return out

    tree = _tree({n.replace("/", "."): c for n, c in columns.items() if not n.startswith("@")})
    inner = F.concat(F.lit(""), *body(tree))
    if not element:
        return inner
    head = F.concat(F.lit(f"<{element}"), *attributes)
    return F.when(inner == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inner, F.lit(f"</{element}>")))


def for_xml_path(df: DataFrame, columns: dict[str, Column], order: list[Column], by: list[str] | None = None, element: str = "row", root: str | None = None) -> DataFrame:
    """SELECT ... FOR XML PATH(element)[, ROOT(root)] as column xml."""
    keys = [o.alias(f"o{i}") for i, o in enumerate(order)]
    rows = F.sort_array(F.collect_list(F.struct(*keys, row_xml(columns, element).alias("x"))))
    text = F.array_join(F.transform(rows, lambda r: r["x"]), "")
    if root:
        text = F.concat(F.lit(f"<{root}>"), text, F.lit(f"</{root}>"))
    return (df.groupBy(*by) if by else df.groupBy()).agg(text.alias("xml"))
