"""Generic signatures of whole tables: parsed in Arrow batches, only where a query asks for them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from bytegrove.catalog import Catalog
from bytegrove.operators.relations import Relations

PARSED = T.StructType(
    [T.StructField("tree", T.StringType()), T.StructField("text", T.StringType()), T.StructField("erased", T.StringType()), T.StructField("type_params", T.IntegerType()), T.StructField("generic", T.BooleanType())]
)
_BINDING = T.StructType([T.StructField(n, T.StringType()) for n in ("supertype", "variable", "argument")])


@F.pandas_udf(PARSED)
def parse_method_signature(sig: pd.Series, desc: pd.Series) -> pd.DataFrame:
    """A method's signature, or its descriptor where it has none or one that can't be parsed."""
    from bytegrove.functions import signatures as S

    rows = []
    for s, d in zip(sig, desc):
        m, generic = None, False
        for text in (s, d):
            if text is not None:
                try:
                    m = S.parse_method(text)
                    generic = text is s and s != d
                    break
                except S.SignatureError:
                    continue
        if m is None:
            rows.append((None, None, None, None, None))
        else:
            shown = f"{S.render_params(m['params'])}({', '.join(S.render(a) for a in m['args'])}) {S.render(m['result'])}".strip()
            rows.append((S.to_json(m), shown, S.erase_method(m), len(m["params"]), generic))
    return pd.DataFrame(rows, columns=["tree", "text", "erased", "type_params", "generic"])


def method_signatures(cat: Catalog) -> DataFrame:
    """(class_name, name, descriptor, text, erased, type_params, generic) of declared methods."""
    m = cat.methods.select("class_name", "name", "descriptor", parse_method_signature("signature", "descriptor").alias("p"))
    return m.select("class_name", "name", "descriptor", "p.text", "p.erased", "p.type_params", "p.generic")


_CLASS = T.StructType([T.StructField("superclass", T.StringType()), T.StructField("interfaces", T.ArrayType(T.StringType())), T.StructField("type_params", T.IntegerType()), T.StructField("generic", T.BooleanType())])


@F.pandas_udf(_CLASS)
def parse_class_signature(sig: pd.Series, plain: pd.Series) -> pd.DataFrame:
    """A class's signature, or the plain one built from its links where it has none or one that can't be parsed."""
    from bytegrove.functions import signatures as S

    rows = []
    for s, d in zip(sig, plain):
        c, generic = None, False
        for text in (s, d):
            if text is not None:
                try:
                    c, generic = S.parse_class(text), text is s
                    break
                except S.SignatureError:
                    continue
        rows.append((None, None, None, None) if c is None else (S.render(c["superclass"]), [S.render(i) for i in c["interfaces"]], len(c["params"]), generic))
    return pd.DataFrame(rows, columns=["superclass", "interfaces", "type_params", "generic"])


def class_signatures(cat: Catalog) -> DataFrame:
    """(class_name, superclass, interfaces, type_params, generic) of every class; without a signature of its own its
    superclass and direct interfaces in the order they are declared."""
    e = cat.edges
    binary = lambda c: F.concat(F.lit("L"), F.translate(c, ".", "/"), F.lit(";"))
    sup = e.where("rel = 'extends'").groupBy(F.col("src").alias("class_name")).agg(F.min("dst").alias("sup"))
    itf = e.where("rel = 'implements'").groupBy(F.col("src").alias("class_name")).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("ord", F.lit(1 << 30)).alias("o"), "dst"))).alias("itfs"))
    plain = F.concat(binary(F.coalesce("sup", F.lit("java.lang.Object"))), F.array_join(F.transform(F.coalesce("itfs", F.array()), lambda x: binary(x["dst"])), ""))
    c = cat.classes.select("class_name", "type_signature").join(sup, "class_name", "left").join(itf, "class_name", "left").select("class_name", parse_class_signature("type_signature", plain).alias("p"))
    return c.select("class_name", "p.superclass", F.array_join("p.interfaces", " ").alias("interfaces"), "p.type_params", "p.generic")


@F.pandas_udf(T.ArrayType(_BINDING))
def _bindings(start: pd.Series, signatures: pd.Series) -> pd.Series:
    from bytegrove.functions import signatures as S

    words = {"*": "?", "+": "? extends ", "-": "? super ", "=": ""}
    out = []
    for name, pairs in zip(start, signatures):
        b = S.supertype_bindings({p["name"]: p["sig"] for p in pairs}, name)
        out.append([{"supertype": t, "variable": v, "argument": words[a["w"]] + S.render(a["t"])} for t, vs in sorted(b.items()) for v, a in vs.items() if t != name])
    return pd.Series(out)


def supertype_arguments(rel: Relations) -> DataFrame:
    """(class_name, supertype, variable, argument): what a class fills in for the type variables of its supertypes.

    A class meets the signatures of its own supertypes only, a list as long as its ancestry; classes without a generic
    supertype give no row.
    """
    sig = rel.cat.classes.where("type_signature is not null").select(F.col("class_name").alias("node"), F.struct(F.col("class_name").alias("name"), F.col("type_signature").alias("sig")).alias("s"))
    own = sig.select(F.col("node").alias("root"), "s")
    above = rel.up().select("root", "node").unionByName(rel.superinterfaces().select(F.col("class_name").alias("root"), F.col("related").alias("node"))).distinct()
    known = own.unionByName(above.join(sig, "node").where("root <> node").select("root", "s"))
    g = known.groupBy("root").agg(F.collect_set("s").alias("s")).where(F.size("s") > 1)
    return g.select(F.col("root").alias("class_name"), F.explode(_bindings("root", "s")).alias("b")).select("class_name", "b.*")
