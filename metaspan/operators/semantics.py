"""Operators over names, comments and concepts: facets, support, variants, signals, relations, reviews, trees and gates.

All take and give DataFrames; column names are parameters where the operator is about a column rather than a table. Groups
are pre-aggregated; nothing pairs all rows of a group but review_difficulty, which pairs those that share a token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaspan.operators import meta as M
from metaspan.operators.relational import numbered

#: Chinese characters, as a pattern.
CJK = r"[㐀-鿿]"
PRIMARY, UNIQUE = "PRIMARY_KEY", ("UNIQUE_KEY", "UNIQUE")


# ---- physical facts
def schema_summary(objects: DataFrame, columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Counts by schema_name; columns and constraints are summed by object before they meet the objects."""
    cols = columns.groupBy("asset_id").agg(F.count("*").alias("c"), F.count("column_comment").alias("cc"), F.count_if("nullable_declared").alias("cn"))
    kind = F.col("constraint_type")
    cons = constraints.groupBy("asset_id").agg(F.count_if(kind == PRIMARY).alias("pk"), F.count_if(kind.isin(*UNIQUE)).alias("uk"), F.count_if(kind == "FOREIGN_KEY").alias("fk"))
    rows = objects.join(cols, "asset_id", "left").join(cons, "asset_id", "left").fillna(0, ["c", "cc", "cn", "pk", "uk", "fk"])
    count = {"tables": F.col("object_type") == "TABLE", "views": F.col("object_type") == "VIEW", "boundary_objects": F.col("is_boundary"), "failed_objects": F.col("extraction_status") == "FAILED", "keyless_objects": F.col("pk") + F.col("uk") == 0, "uncommented_objects": F.col("object_comment").isNull()}
    total = {"columns": "c", "commented_columns": "cc", "nullable_columns": "cn", "primary_keys": "pk", "unique_keys": "uk", "foreign_keys": "fk"}
    return rows.groupBy("schema_name").agg(F.count("*").alias("objects"), *[F.count_if(c).alias(n) for n, c in count.items()], *[F.sum(c).alias(n) for n, c in total.items()])


def key_strata(objects: DataFrame, columns: DataFrame, constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    """(asset_id, object_name, stratum, n_columns, fingerprint): stratum by the shape of the declared keys."""
    kind = F.col("constraint_type")
    cons = constraints.groupBy("asset_id").agg(F.max(F.when(kind == PRIMARY, F.size("column_ids"))).alias("pk"), F.count_if(kind.isin(*UNIQUE)).alias("uk"))
    rows = objects.select("asset_id", "object_name").join(cons, "asset_id", "left").join(indexes.groupBy("asset_id").agg(F.count("*").alias("ix")), "asset_id", "left")
    rows = rows.join(columns.groupBy("asset_id").agg(F.count("*").alias("n_columns")), "asset_id", "left").join(M.structure_fingerprint(columns), "asset_id", "left")
    stratum = F.when(F.col("pk") > 1, "PK_COMPOSITE").when(F.col("pk") == 1, "PK_SINGLE").when(F.col("uk") > 0, "UK_ONLY").when(F.col("ix") > 0, "NO_KEY_WITH_INDEX").otherwise("NO_DECLARED_KEY")
    return rows.select("asset_id", "object_name", stratum.alias("stratum"), F.coalesce("n_columns", F.lit(0)).alias("n_columns"), "fingerprint")


def stratified_sample(strata: DataFrame) -> DataFrame:
    """Of key_strata's rows the widest object of each stratum (ties: least name) and, of the structures that several objects
    share, the two first objects of the widest one; with the reason."""
    best = F.min(F.struct(-F.col("n_columns"), "object_name", "asset_id"))
    widest = strata.groupBy("stratum").agg(best.alias("b")).select("b.asset_id", F.lit("WIDEST_OF_STRATUM").alias("reason"))
    twins = strata.groupBy("fingerprint").agg(F.count("*").alias("n"), F.max("n_columns").alias("w"), F.min("object_name").alias("first"))
    twins = twins.filter("n > 1 and fingerprint is not null").orderBy(F.desc("w"), "first").limit(1).select("fingerprint")
    pair = strata.join(twins, "fingerprint").orderBy("object_name").limit(2).select("asset_id", F.lit("SAME_STRUCTURE").alias("reason"))
    return widest.unionByName(pair)


def column_features(columns: DataFrame, constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    """(column_id, in_primary_key, in_unique_key, in_foreign_key, in_index)."""
    kind = F.col("constraint_type")
    listed = constraints.select(F.explode("column_ids").alias("column_id"), "constraint_type").groupBy("column_id")
    keys = listed.agg(F.bool_or(kind == PRIMARY).alias("in_primary_key"), F.bool_or(kind.isin(*UNIQUE)).alias("in_unique_key"), F.bool_or(kind == "FOREIGN_KEY").alias("in_foreign_key"))
    ix = indexes.select(F.explode("column_ids").alias("column_id")).distinct().withColumn("in_index", F.lit(True))
    flags = ["in_primary_key", "in_unique_key", "in_foreign_key", "in_index"]
    return columns.select("column_id").join(keys, "column_id", "left").join(ix, "column_id", "left").fillna(False, flags)


def field_summaries(columns: DataFrame, markers: dict[str, Sequence[str]]) -> DataFrame:
    """(asset_id, n_fields, signature, markers): SHA-256 of the sorted distinct upper-cased names joined by `|`, and for each
    marker the names that hold one of its terms."""
    name = F.upper("column_name")
    rows = columns.groupBy("asset_id").agg(F.count("*").alias("n_fields"), F.array_sort(F.collect_set(name)).alias("names"))
    one = lambda terms: F.filter("names", lambda n: F.greatest(*[F.contains(n, F.lit(x.upper())) for x in terms], F.lit(False)))
    hit = {m: one(terms) for m, terms in markers.items()}
    found = F.map_filter(F.create_map(*[x for m, names in hit.items() for x in (F.lit(m), names)]), lambda _, names: F.size(names) > 0)
    return rows.select("asset_id", "n_fields", F.sha2(F.array_join("names", "|"), 256).alias("signature"), found.alias("markers"))


def structural_inference(objects: DataFrame, columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """(kind, subject, value, strength) candidates: identity and grain from declared keys, field roles from key membership,
    name parts and comments, object roles from comments, relations from foreign keys."""
    out = []
    keys = constraints.filter(F.col("constraint_type").isin(PRIMARY, *UNIQUE))
    value = F.concat_ws("|", F.transform("column_ids", lambda c: F.element_at(F.split(c, ":"), -1)))
    for kind in ("IDENTITY", "GRAIN"):
        out.append(keys.select(F.lit(kind).alias("kind"), F.col("asset_id").alias("subject"), value.alias("value"), F.lit("DECLARED").alias("strength")))
    member = keys.select(F.explode("column_ids").alias("column_id")).distinct().withColumn("key", F.lit(True))
    cols = columns.join(member, "column_id", "left")
    part = F.split(F.upper("column_name"), "_")
    comment = F.lower(F.coalesce("column_comment", F.lit("")))
    says = lambda text, words: F.greatest(*[F.contains(text, F.lit(w)) for w in words], F.lit(False))
    for role, token, words in FIELD_ROLES:
        named = F.array_contains(part, token) if token else F.lit(False)
        mine = F.coalesce(F.col("key"), F.lit(False)) if role == "IDENTIFIER" else F.lit(False)
        hit = cols.filter(mine | named | says(comment, words))
        out.append(hit.select(F.lit("FIELD_ROLE").alias("kind"), F.col("column_id").alias("subject"), F.lit(role).alias("value"), F.when(mine, "DECLARED").otherwise("WEAK").alias("strength")))
    said = F.lower(F.coalesce("object_comment", F.lit("")))
    for role, words in OBJECT_ROLES:
        out.append(objects.filter(says(said, words)).select(F.lit("OBJECT_ROLE").alias("kind"), F.col("asset_id").alias("subject"), F.lit(role).alias("value"), F.lit("WEAK").alias("strength")))
    links = constraints.filter("constraint_type = 'FOREIGN_KEY' and referenced_asset_id is not null")
    out.append(links.select(F.lit("RELATION").alias("kind"), F.col("asset_id").alias("subject"), F.col("referenced_asset_id").alias("value"), F.lit("DECLARED").alias("strength")))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


#: Field role, the part of a name that tells it, and words of a comment that do.
FIELD_ROLES = [
    ("IDENTIFIER", None, ["标识", "编号", "代码", "identifier"]),
    ("STATUS", "STATUS", ["状态", "status"]),
    ("TYPE_CODE", "TYPE", ["类型", "分类", "type"]),
    ("AMOUNT", "AMT", ["金额", "本金", "amount"]),
    ("QUANTITY", "QTY", ["数量", "手数", "quantity"]),
    ("TIME", None, ["日期", "时间", "date", "time"]),
]
#: Object role and words of a comment that tell it.
OBJECT_ROLES = [
    ("EVENT_TRANSACTION", ["事件", "交易", "event", "transaction"]),
    ("STATE_HISTORY", ["历史", "history"]),
    ("SNAPSHOT", ["当前", "快照", "snapshot", "current"]),
    ("REFERENCE_CONFIG", ["参数", "配置", "parameter", "config"]),
]


def physical_variants(objects: DataFrame, columns: DataFrame, keys: DataFrame, rules: Sequence[tuple[str, str]], subjects: DataFrame, most: int = 3) -> DataFrame:
    """(asset_id, base, rule, disposition, parents) for objects(asset_id, object_name, object_type, object_comment).

    rules (name, pattern), in order of priority, take an ending off a name. A parent is the object of the base name, or, where
    a rule fitted and there is none, a subject whose name starts with the base and `_`. Parents rank by 0.65 * column Jaccard +
    0.25 * key Jaccard + 0.1 for an equal comment; strong ones share 0.8 of the columns and the type. columns and keys:
    (asset_id, column_name).
    """
    name = F.upper(F.trim("object_name"))
    fits = [(rule, F.regexp_replace(F.regexp_replace(name, f"(?i)(?:{p}).*$", ""), "_+$", ""), name.rlike(f"(?i)(?:{p})")) for rule, p in rules]
    good = [(rule, base, hit & (base != "") & (base != name)) for rule, base, hit in fits]
    rule = F.coalesce(*[F.when(hit, F.lit(r)) for r, _, hit in good], F.lit(None).cast("string"))
    base = F.coalesce(*[F.when(hit, b) for _, b, hit in good], name)
    mine = subjects.select("asset_id").distinct().withColumn("subject", F.lit(True))
    rows = objects.withColumns({"name": name, "rule": rule, "base": base}).join(mine, "asset_id", "left").fillna(False, ["subject"])
    child = rows.filter("not subject").select("asset_id", "base", "rule", "object_type", "object_comment")
    up = rows.select(F.col("asset_id").alias("parent"), "name", "subject", F.col("object_type").alias("ptype"), F.col("object_comment").alias("pcomment"))
    exact = child.join(up, child["base"] == up["name"]).drop("name", "subject")
    # a subject's name is cut at each `_`, so that the prefix rule is an equi-join
    heads = F.transform(F.sequence(F.lit(1), F.size(F.split("name", "_")) - 1), lambda i: F.array_join(F.slice(F.split("name", "_"), F.lit(1), i), "_"))
    cut = up.filter(F.col("subject") & F.contains("name", F.lit("_"))).withColumn("head", F.explode(heads)).drop("name", "subject")
    loose = child.filter("rule is not null").join(up.select(F.col("name").alias("base")), "base", "left_anti")
    loose = loose.join(cut, loose["base"] == cut["head"]).drop("head")
    met = exact.unionByName(loose).filter("asset_id <> parent")
    sets = lambda df, a: df.groupBy(F.col("asset_id").alias(a)).agg(F.collect_set(F.upper("column_name")).alias(f"{a}_set"))
    none = F.array().cast("array<string>")
    met = met.join(sets(columns, "asset_id"), "asset_id", "left").join(sets(columns, "parent"), "parent", "left").withColumn("cols", M.jaccard(F.coalesce("asset_id_set", none), F.coalesce("parent_set", none), 1.0)).drop("asset_id_set", "parent_set")
    met = met.join(sets(keys, "asset_id"), "asset_id", "left").join(sets(keys, "parent"), "parent", "left").withColumn("keyed", M.jaccard(F.coalesce("asset_id_set", none), F.coalesce("parent_set", none), 1.0)).drop("asset_id_set", "parent_set")
    same = F.coalesce((F.col("object_comment") == F.col("pcomment")) & (F.col("object_comment") != ""), F.lit(False))
    met = met.withColumn("score", F.round(F.col("cols") * 0.65 + F.col("keyed") * 0.25 + F.when(same, 0.1).otherwise(0.0), 6))
    met = met.withColumn("r", F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("score"), "parent"))).filter(F.col("r") <= most)
    strong = F.count_if((F.col("cols") >= 0.8) & F.col("object_type").eqNullSafe(F.col("ptype")))
    found = met.groupBy("asset_id").agg(strong.alias("strong"), F.transform(F.array_sort(F.collect_list(F.struct("r", "parent"))), lambda x: x["parent"]).alias("parents"))
    out = rows.join(found, "asset_id", "left")
    state = F.when(F.col("subject"), "SUBJECT").when(F.col("strong") == 1, "LIKELY_VARIANT").when(F.col("strong") > 1, "COMPETING_PARENT").when(F.col("rule").isNotNull() & F.col("parents").isNotNull(), "UNKNOWN").otherwise("STANDALONE")
    own = lambda c, instead: F.when(F.col("subject"), instead).otherwise(c)
    return out.select("asset_id", own(F.col("base"), F.col("name")).alias("base"), own(F.col("rule"), F.lit(None)).alias("rule"), state.alias("disposition"), F.coalesce("parents", none).alias("parents"))


def current_history_pairs(objects: DataFrame, columns: DataFrame, least: float = 0.5) -> DataFrame:
    """(current_id, history_id, similarity, evidence): objects whose name with CURRENT becomes another's with HIS, or else
    HISTORY; one piece of evidence for the name, a second where the columns' Jaccard similarity reaches `least`."""
    name = F.upper("object_name")
    now = objects.filter(F.contains(name, F.lit("CURRENT"))).select(F.col("asset_id").alias("current_id"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.replace(name, F.lit("CURRENT"), F.lit("HIS")).alias("n")), F.struct(F.lit(1).alias("k"), F.replace(name, F.lit("CURRENT"), F.lit("HISTORY")).alias("n")))).alias("x"))
    then = objects.select(F.col("asset_id").alias("history_id"), name.alias("n"))
    met = now.join(then, F.col("x.n") == F.col("n")).groupBy("current_id").agg(F.min_by("history_id", F.struct("x.k", "history_id")).alias("history_id"))
    sets = lambda a: columns.groupBy(F.col("asset_id").alias(a)).agg(F.collect_set(F.upper("column_name")).alias(f"{a}_set"))
    none = F.array().cast("array<string>")
    out = met.join(sets("current_id"), "current_id", "left").join(sets("history_id"), "history_id", "left")
    same = F.round(M.jaccard(F.coalesce("current_id_set", none), F.coalesce("history_id_set", none), 1.0), 6)
    return out.select("current_id", "history_id", same.alias("similarity"), F.when(same >= least, 2).otherwise(1).alias("evidence"))


# ---- similarity graphs
def edge_filter(pairs: DataFrame, schemas: DataFrame, least: float, signals: int) -> DataFrame:
    """pairs(a, b, score, signals) of at least `least`; across schemas(item, schema) at least `signals` supporting signals."""
    a, b = schemas.select(F.col("item").alias("a"), F.col("schema").alias("sa")), schemas.select(F.col("item").alias("b"), F.col("schema").alias("sb"))
    return pairs.filter(F.col("score") >= least).join(a, "a").join(b, "b").filter((F.col("sa") == F.col("sb")) | (F.col("signals") >= signals)).select(*pairs.columns)


def sparse_edges(top: DataFrame, direct: DataFrame, most: int | None = None) -> DataFrame:
    """The pairs of top(a, b, score), each item's choices, in which each has chosen the other, and all of direct(a, b, score);
    of these the `most` best."""
    straight = direct.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    kept = M.mutual(top, "score").unionByName(straight).distinct()
    return kept if most is None else kept.orderBy(F.desc("score"), "a", "b").limit(most)


def family_status(members: DataFrame, edges: DataFrame, least_size: int = 2, least_views: int = 2, least_edges: int = 1) -> DataFrame:
    """(item, family, status, role, score) from members(item, family, n) and edges(a, b, views) inside families.

    An item stands for n alike ones (without the column for one); an edge a = b then joins all of these. A family below
    least_size is a SINGLETON; it is a CANDIDATE with least_edges edges of least_views views, else WEAK. Items of the greatest
    degree are its CORE, the others its EDGE; the score is the degree over the greatest.
    """
    members = members.select("item", "family", F.col("n").cast("long").alias("n") if "n" in members.columns else F.lit(1).cast("long").alias("n"))
    of = lambda c, f, n: members.select(F.col("item").alias(c), F.col("family").alias(f), F.col("n").alias(n))
    inner = edges.join(of("a", "fa", "na"), "a").join(of("b", "fb", "nb"), "b").filter("fa = fb")
    left = inner.select(F.col("a").alias("item"), F.when(F.col("a") == F.col("b"), F.col("nb") - 1).otherwise(F.col("nb")).alias("k"))
    ends = left.unionAll(inner.filter("a <> b").select(F.col("b").alias("item"), F.col("na").alias("k"))).groupBy("item").agg(F.sum("k").alias("degree"))
    rows = members.join(ends, "item", "left").fillna(0, ["degree"])
    sizes = rows.groupBy("family").agg(F.sum("n").alias("_n"), F.max("degree").alias("top"))
    links = F.when(F.col("a") == F.col("b"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    multi = inner.filter(F.col("views") >= least_views).groupBy(F.col("fa").alias("family")).agg(F.sum(links).alias("multi"))
    out = rows.join(sizes, "family").join(multi, "family", "left")
    status = F.when(F.col("_n") < least_size, "SINGLETON").when(F.col("multi") >= least_edges, "CANDIDATE").otherwise("WEAK")
    role = F.when((F.col("top") > 0) & (F.col("degree") == F.col("top")), "CORE").otherwise("EDGE")
    return out.select("item", "family", status.alias("status"), role.alias("role"), F.round(F.col("degree") / F.greatest("top", F.lit(1).cast("long")), 6).alias("score"))


def member_rollup(tree: DataFrame, members: DataFrame) -> DataFrame:
    """(node, members): distinct items of members(node, item) at each node of tree(child, parent) or below it."""
    from metaspan.operators.graph import reach

    own = members.select("node", "item").distinct()
    up = reach(tree.select(F.col("child").alias("src"), F.col("parent").alias("dst")), own.select("node").distinct())
    return own.join(up.select(F.col("seed").alias("node"), F.col("node").alias("over")), "node").groupBy(F.col("over").alias("node")).agg(F.count_distinct("item").alias("members"))


def char_recall(labels: DataFrame, least: float, key: str = "id", text: str = "text", k: int | None = None) -> DataFrame:
    """(a, b, score, kind) with a < b: labels whose characters are near by the cosine of 2- and 3-grams, weighted
    (1 + ln tf) * idf; kind is POSSIBLE_TYPO at one edit, else APPROXIMATE_COMPETITOR. With k each a keeps its k best b."""
    t = F.col(text)
    run = lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
    runs = [run(n) for n in (2, 3)]
    none = F.array().cast("array<string>")
    grams = labels.select(F.col(key).alias("d"), F.explode(F.concat(*[F.when(F.length(t) >= n, r).otherwise(none) for n, r in zip((2, 3), runs)])).alias("g"))
    idf = M.inverse_frequency(grams, "d", "g")
    n = labels.agg(F.count("*").alias("all"))
    idf = idf.join(F.broadcast(n)).select("g", (F.log((1 + F.col("all")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = grams.groupBy("d", "g").agg(F.count("*").alias("tf")).join(idf, "g").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = w.groupBy("d").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    pairs = M.cosine_pairs(w.join(norm, "d").select("d", "g", (F.col("w") / F.col("n")).alias("weight")), "d", "g", least)
    if k is not None:
        pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).filter(F.col("r") <= k)
    la, lb = labels.select(F.col(key).alias("a"), t.alias("ta")), labels.select(F.col(key).alias("b"), t.alias("tb"))
    kind = F.when(F.levenshtein("ta", "tb") == 1, "POSSIBLE_TYPO").otherwise("APPROXIMATE_COMPETITOR")
    return pairs.join(la, "a").join(lb, "b").select("a", "b", F.round("cosine", 6).alias("score"), kind.alias("kind"))


# ---- expressions and concepts
def facets(text: Column, rules: Sequence[tuple[str, str, Sequence[str]]]) -> Column:
    """struct(rest, found): rules (dimension, value, fragments) are tried in order; a rule's longest fragment that the text
    holds is taken out of it and noted. rest has runs of blanks as one."""
    kind = "array<struct<dimension:string,value:string,fragment:string>>"
    listed = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(v).alias("v"), F.array(*[F.lit(p) for p in sorted(ps, key=lambda p: (-len(p), p))]).alias("p")) for d, v, ps in rules])
    zero = F.struct(F.coalesce(text, F.lit("")).alias("rest"), F.array().cast(kind).alias("found"))

    def take(acc: Column, r: Column) -> Column:
        hit = F.try_element_at(F.filter(r["p"], lambda p: F.contains(acc["rest"], p)), F.lit(1))
        noted = F.concat(acc["found"], F.array(F.struct(r["d"].alias("dimension"), r["v"].alias("value"), hit.alias("fragment"))))
        return F.when(hit.isNull(), acc).otherwise(F.struct(F.replace(acc["rest"], hit, F.lit("")).alias("rest"), noted.alias("found")))

    return F.aggregate(listed, zero, take, lambda a: F.struct(F.trim(F.regexp_replace(a["rest"], r"\s+", " ")).alias("rest"), F.array_sort(a["found"]).alias("found")))


def field_family(text: Column, families: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The family whose longest shape ends the text (blanks aside); ties go to the greatest family name."""
    shapes = sorted({("".join(p.split()), f) for f, ps in families for p in ps}, key=lambda x: (len(x[0]), x[1]), reverse=True)
    squeezed = F.regexp_replace(text, r"\s+", "")
    return F.coalesce(*[F.when(F.endswith(squeezed, F.lit(p)), F.lit(f)) for p, f in shapes], F.lit(None).cast("string"))


def head_terms(text: Column, aliases: Sequence[str], dull: Sequence[str] = ()) -> Column:
    """struct(heads, related): the longest alias that the text holds is its head; if more text follows it, the whole text is
    the head and the alias is related. Without an alias the longest word that is not dull is the head."""
    names = F.array(*[F.lit(a) for a in sorted(aliases, key=lambda a: (len(a), a), reverse=True)])
    t = F.trim(F.coalesce(text, F.lit("")))
    alias = F.try_element_at(F.filter(names, lambda a: F.contains(t, a)), F.lit(1))
    behind = F.trim(F.substring(t, F.instr(t, alias) + F.length(alias), F.length(t)))
    words = F.filter(F.split(t, r"\s+"), lambda w: (w != "") & ~w.isin(*dull)) if dull else F.filter(F.split(t, r"\s+"), lambda w: w != "")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    none = F.array().cast("array<string>")
    heads = F.when(alias.isNotNull(), F.array(F.when(behind != "", t).otherwise(alias))).when(longest.isNotNull(), F.array(longest)).otherwise(none)
    return F.struct(heads.alias("heads"), F.when(alias.isNotNull() & (behind != ""), F.array(alias)).otherwise(none).alias("related"))


def concept_support(bindings: DataFrame, least: int) -> DataFrame:
    """(concept, fields, objects, expressions, facets, status) from bindings(concept, field, object, expression, facet): SUPPORTED
    needs `least` fields and a second view, that is two objects, expressions or facets; else PROVISIONAL."""
    many = {"fields": "field", "objects": "object", "expressions": "expression", "facets": "facet"}
    out = bindings.groupBy("concept").agg(*[F.count_distinct(c).alias(n) for n, c in many.items()])
    second = F.greatest("objects", "expressions", "facets") >= 2
    return out.withColumn("status", F.when((F.col("fields") >= least) & second, "SUPPORTED").otherwise("PROVISIONAL"))


def concept_bindings(fields: DataFrame, most: int) -> DataFrame:
    """(field, concept, relation, rank, score, status) from fields(field, heads, related): the first `most` heads EXPRESS the
    field, scored 1 / rank and in CONFLICT where there are several; related concepts that are no head are RELATED_TO."""
    heads = F.slice("heads", 1, most)
    direct = fields.select("field", F.posexplode(heads).alias("r", "concept"), F.size(heads).alias("n"))
    direct = direct.select("field", "concept", F.lit("EXPRESSES").alias("relation"), (F.col("r") + 1).alias("rank"), F.round(1 / (F.col("r") + 1), 6).alias("score"), F.when(F.col("n") == 1, "CANDIDATE").otherwise("CONFLICT").alias("status"))
    loose = fields.select("field", F.explode(F.array_except("related", heads)).alias("concept"), F.lit("RELATED_TO").alias("relation"))
    return direct.unionByName(loose.withColumns({"rank": F.lit(None).cast("int"), "score": F.lit(None).cast("double"), "status": F.lit("CANDIDATE")}))


def expression_groups(rows: DataFrame, key: Sequence[str], text: str, source: str, least: int) -> DataFrame:
    """One row per key: its texts, the number of distinct sources, and CONFLICT where texts differ, INSUFFICIENT_EVIDENCE
    below `least` sources, else CANDIDATE."""
    out = rows.groupBy(*key).agg(F.array_sort(F.collect_set(text)).alias("texts"), F.count_distinct(source).alias("support"))
    return out.withColumn("status", F.when(F.size("texts") > 1, "CONFLICT").when(F.col("support") < least, "INSUFFICIENT_EVIDENCE").otherwise("CANDIDATE"))


def recurrent_cores(labels: DataFrame, label: str, least: int = 2, implicit: str | None = CJK) -> DataFrame:
    """(core, labels): strings of at least `least` characters that begin or end two labels or more: labels themselves, and
    common endings that match `implicit`, unless a longer ending has the same labels. Endings are generated, not compared."""
    rows = labels.select(F.col(label).alias("l")).filter("l is not null").distinct()
    size = F.length("l")
    cut = lambda start: F.transform(F.sequence(F.lit(least), size), lambda n: F.substring("l", F.lit(1), n) if start else F.substring("l", size - n + 1, n))
    long = rows.filter(size >= least)
    ends = long.select("l", F.explode(cut(False)).alias("core"))
    both = ends.unionByName(long.select("l", F.explode(cut(True)).alias("core"))).distinct()
    spoken = both.join(rows.select(F.col("l").alias("core")), "core", "left_semi").groupBy("core").agg(F.count("*").alias("labels"))
    out = spoken
    if implicit is not None:
        kept = ends.groupBy("core").agg(F.count("*").alias("labels")).filter(F.col("labels") >= 2)
        longer = kept.filter(F.length("core") > least).select(F.expr("substring(core, 2)").alias("core"), "labels")
        kept = kept.filter(F.col("core").rlike(implicit)).join(longer, ["core", "labels"], "left_anti").join(rows.select(F.col("l").alias("core")), "core", "left_anti")
        out = spoken.unionByName(kept)
    return out.filter("labels >= 2")


def longest_core(labels: DataFrame, label: str, cores: DataFrame) -> DataFrame:
    """(label, core, before, after): the longest of cores(core) that begins or ends the label (or is it), and what is left of
    the label on either side; a label without one is its own core."""
    rows = labels.select(F.col(label).alias("label")).filter("label is not null").distinct()
    size = F.length("label")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda n: F.array(F.substring("label", F.lit(1), n), F.substring("label", size - n + 1, n))))
    met = rows.filter(size > 0).withColumn("core", F.explode(F.array_distinct(pieces))).join(cores.select("core").distinct(), "core")
    best = met.groupBy("label").agg(F.max(F.struct(F.length("core").alias("n"), (F.col("core") == F.col("label")).alias("own"), "core"))["core"].alias("core"))
    out = rows.join(best, "label", "left").withColumn("core", F.coalesce("core", "label"))
    n, tail = F.length("core"), F.endswith("label", "core")
    before = F.when((F.col("label") != F.col("core")) & tail, F.expr("left(label, length(label) - length(core))")).otherwise("")
    after = F.when((F.col("label") != F.col("core")) & ~tail, F.substring("label", n + 1, F.length("label"))).otherwise("")
    return out.select("label", "core", before.alias("before"), after.alias("after"))


def longest_term(items: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, areas, status) by terms(area, term): the area of the longest term that the text holds; words of other than
    Chinese count as whole words and weigh 1, so several areas of one weight are a CONFLICT. None is UNKNOWN.

    terms is a small vocabulary of checked size; items meet it by broadcast."""
    vocabulary = terms.select("area", F.lower(F.trim("term")).alias("term")).filter("term <> ''")
    if vocabulary.count() > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    label = F.lower(F.trim(text))
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("term"), F.lit(r"\E(?![a-z0-9])"))
    cjk = F.col("term").rlike(CJK)
    hit = (cjk & F.contains(label, F.col("term"))) | (~cjk & F.call_function("rlike", label, quoted))
    met = items.select(F.col(key), F.col(text)).join(F.broadcast(vocabulary), hit)
    score = met.groupBy(key, "area").agg(F.max(F.when(cjk, F.length("term")).otherwise(1)).alias("s"))
    best = score.groupBy(key).agg(F.max("s").alias("s"))
    areas = score.join(best, [key, "s"]).groupBy(key).agg(F.array_sort(F.collect_set("area")).alias("areas"))
    out = items.select(key).join(areas, key, "left")
    status = F.when(F.col("areas").isNull(), "UNKNOWN").when(F.size("areas") == 1, "CANDIDATE").otherwise("CONFLICT")
    return out.select(key, F.coalesce("areas", F.array().cast("array<string>")).alias("areas"), status.alias("status"))


MAX_TERMS = 10_000


def attribute_shapes(labels: DataFrame, label: str, least: int = 2) -> DataFrame:
    """(shape, labels): endings that `least` labels or more share: the last Latin word, upper-cased, else the last two
    characters of a Chinese label; a label that is its own ending has none."""
    t = F.trim(F.col(label))
    word = F.regexp_extract(t, r"[A-Za-z][A-Za-z0-9_-]*$", 0)
    tail = F.when(word != "", F.upper(word)).when(t.rlike(CJK) & (F.length(t) >= 2), F.substring(t, -2, 2))
    rows = labels.select(t.alias("l"), tail.alias("shape")).filter("shape is not null and shape <> l").distinct()
    return rows.groupBy("shape").agg(F.count("*").alias("labels")).filter(F.col("labels") >= least)


def name_comment_signals(tables: DataFrame, vocabulary: DataFrame, rival: str, most: int) -> DataFrame:
    """(asset_id, source, dimension, label, rank, score, outcome) from tables(asset_id, name, comment) and
    vocabulary(dimension, label, term): labels with a term in the name or the comment, the `most` first of each; where name
    and comment both have labels of the `rival` dimension and these differ, they are COMPETING."""
    words = vocabulary.select("dimension", "label", F.upper("term").alias("term"))
    if words.count() > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    texts = tables.select("asset_id", F.explode(F.create_map(F.lit("NAME"), F.upper(F.coalesce("name", F.lit(""))), F.lit("COMMENT"), F.upper(F.coalesce("comment", F.lit(""))))).alias("source", "text"))
    hits = texts.join(F.broadcast(words), F.contains("text", "term")).select("asset_id", "source", "dimension", "label").distinct()
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("asset_id", "source", "dimension").orderBy("label"))).filter(F.col("rank") <= most)
    sides = ranked.filter(F.col("dimension") == rival).groupBy("asset_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("source") == s, F.col("label")))).alias(s) for s in ("NAME", "COMMENT")])
    sides = sides.filter("size(NAME) > 0 and size(COMMENT) > 0 and NAME <> COMMENT").select("asset_id", F.lit(rival).alias("dimension"), F.lit(True).alias("c"))
    out = ranked.join(sides, ["asset_id", "dimension"], "left")
    return out.select("asset_id", "source", "dimension", "label", "rank", F.round(1 / F.col("rank"), 6).alias("score"), F.when(F.col("c"), "COMPETING").otherwise("CANDIDATE").alias("outcome"))


def relation_candidates(relations: DataFrame, predicates: DataFrame, known: DataFrame) -> DataFrame:
    """relations(subject, predicate, object, evidence, counter) against predicates(predicate, least, directed) and known(item):
    an unknown end is UNKNOWN_ENDPOINT; too few distinct pieces of evidence turn the predicate into the undirected
    RELATED_TO, outcome UNKNOWN; counter-evidence leaves the predicate and makes the outcome UNKNOWN."""
    ends = [relations]
    for side in ("subject", "object"):
        ends.append(ends[-1].join(known.select(F.col("item").alias(side), F.lit(True).alias(f"has_{side}")).distinct(), side, "left"))
    rows = ends[-1].join(F.broadcast(predicates), "predicate", "left")
    enough = F.coalesce(F.size(F.array_distinct("evidence")) >= F.col("least"), F.lit(False))
    gone = F.col("has_subject").isNull() | F.col("has_object").isNull()
    outcome = F.when(gone, "UNKNOWN_ENDPOINT").when(enough & (F.size("counter") == 0), "CANDIDATE").otherwise("UNKNOWN")
    return rows.select("subject", F.when(enough, F.col("predicate")).otherwise("RELATED_TO").alias("predicate"), F.col("predicate").alias("requested"), "object", (enough & F.col("directed")).alias("directed"), outcome.alias("outcome"))


# ---- comments and facets
def same_name_reviews(fields: DataFrame, name: str, comment: str, key: str) -> DataFrame:
    """(name, variants): names whose comments (blanks squeezed, empty ones aside) differ, each with its fields."""
    n = F.upper(F.trim(F.regexp_replace(F.trim(F.col(name)), '^"|"$', "")))
    c = F.trim(F.regexp_replace(F.coalesce(F.col(comment), F.lit("")), r"\s+", " "))
    rows = fields.select(n.alias("name"), c.alias("comment"), F.col(key).alias("ref")).filter("name <> '' and comment <> ''")
    one = rows.groupBy("name", "comment").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    out = one.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("comment", "refs"))).alias("variants"))
    return out.filter(F.size("variants") > 1)


def comment_consensus(fields: DataFrame, key: Sequence[str], comment: str, ref: str) -> DataFrame:
    """key, agreed, refs: the one comment that all commented fields of a key have; keys of several have no row."""
    c = F.trim(F.regexp_replace(F.col(comment), r"\s+", " "))
    out = fields.withColumn("_c", c).filter("_c <> ''").groupBy(*key).agg(F.min("_c").alias("agreed"), F.max("_c").alias("_last"), F.array_sort(F.collect_set(ref)).alias("refs"))
    return out.filter("agreed = _last").drop("_last")


def facet_signature(rows: DataFrame, binding: str, exclusive: Sequence[str]) -> DataFrame:
    """(binding, dimension, chosen, conflict) from rows(binding, dimension, value, fragment). Values of an exclusive dimension
    that differ are in conflict: those from Chinese fragments win, if any (COMMENT_NAME_DISAGREEMENT), else all stay
    (SAME_SOURCE_DISAGREEMENT)."""
    said = F.when(F.col("fragment").rlike(CJK), F.col("value"))
    out = rows.groupBy(binding, "dimension").agg(F.array_sort(F.collect_set("value")).alias("all"), F.array_sort(F.collect_set(said)).alias("said"))
    rival = F.col("dimension").isin(*exclusive) & (F.size("all") > 1)
    won = rival & (F.size("said") > 0)
    return out.select(binding, "dimension", F.when(won, F.col("said")).otherwise(F.col("all")).alias("chosen"), F.when(won, "COMMENT_NAME_DISAGREEMENT").when(rival, "SAME_SOURCE_DISAGREEMENT").alias("conflict"))


def consolidate(assertions: DataFrame, key: Sequence[str], evidence: str) -> DataFrame:
    """One row per key with the sorted union of its evidence arrays."""
    return assertions.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(evidence)))).alias(evidence))


def most_common(rows: DataFrame, group: Sequence[str], value: str, position: str) -> DataFrame:
    """group, value, n: each group's most frequent value that is not null; of equal ones the first by position."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"), F.min(position).alias("_p"))
    best = counted.groupBy(*group).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col("_p"))).alias("_b"))
    return best.select(*group, f"_b.{value}", "_b.n")


# ---- reviews
def review_batches(items: DataFrame, kind: str, key: str, size: int = 20) -> DataFrame:
    """items with batch, from 1: packs of `size` items of one kind in order of the (unique) key."""
    rows = numbered(items, [kind, key], "_n")
    first = rows.groupBy(F.col(kind).alias("_k")).agg(F.min("_n").alias("_first"))
    out = rows.join(first, F.col(kind).eqNullSafe(F.col("_k")))
    return out.withColumn("batch", (F.floor((F.col("_n") - F.col("_first")) / size) + 1).cast("long")).drop("_n", "_k", "_first")


def import_review(responses: DataFrame, known: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """(item_key, decision, status) of responses(item_key, decision, rationale): UNKNOWN_ID where known(item_key) lacks it,
    DUPLICATE where several responses name it, INVALID_DECISION, NO_RATIONALE, else IMPORTED. One row per response."""
    rows = responses.select(F.trim("item_key").alias("item_key"), F.upper(F.trim("decision")).alias("decision"), F.trim("rationale").alias("rationale"))
    times = rows.groupBy("item_key").agg(F.count("*").alias("n"))
    have = known.select(F.trim("item_key").alias("item_key")).distinct().withColumn("known", F.lit(True))
    out = rows.join(times, "item_key", "left").join(have, "item_key", "left")
    status = F.when(F.col("known").isNull(), "UNKNOWN_ID").when(F.col("n") > 1, "DUPLICATE").when(~F.coalesce(F.col("decision").isin(*allowed), F.lit(False)), "INVALID_DECISION").when(F.coalesce("rationale", F.lit("")) == "", "NO_RATIONALE").otherwise("IMPORTED")
    return out.select("item_key", "decision", status.alias("status"))


def review_difficulty(members: DataFrame, labels: DataFrame, rivals: DataFrame, low: float = 0.5, outlier: float = 0.3, weak: float = 0.5) -> DataFrame:
    """(group, n, cohesion, outlier_ratio, label_support, ambiguity, score) for members(group, item, tokens, text), tokens being
    distinct, labels(group, label) and rivals(item), items with a meaningful other group.

    Cohesion is the mean Jaccard similarity of a member's tokens with each other member's. Pairs without a common token
    have 0, so only pairs with one are made. score = max(0, low - cohesion) + outlier ratio + max(0, weak - label support) +
    ambiguity.
    """
    # members of a group with equal tokens are one kind; whole numbers are summed over each denominator, in order
    kinds = M.cut(members.groupBy("group", F.array_sort("tokens").alias("tokens")).agg(F.count("*").alias("n")).withColumn("kind", F.row_number().over(Window.partitionBy("group").orderBy("tokens"))))
    words = kinds.select("group", "kind", "n", F.size("tokens").alias("k"), F.explode("tokens").alias("t"))
    other = words.select("group", "t", F.col("kind").alias("kind2"), F.col("n").alias("n2"), F.col("k").alias("k2"))
    met = words.join(other, ["group", "t"]).groupBy("group", "kind", "kind2", "n2", "k", "k2").agg(F.count("*").alias("c"))
    met = met.select("group", "kind", (F.col("c") * (F.col("n2") - (F.col("kind") == F.col("kind2")).cast("int"))).alias("x"), (F.col("k") + F.col("k2") - F.col("c")).alias("u"))
    met = met.groupBy("group", "kind", "u").agg(F.sum("x").alias("x"))
    near = met.groupBy("group", "kind").agg(F.array_sort(F.collect_list(F.struct("u", "x"))).alias("l"))
    near = near.select("group", "kind", F.aggregate("l", F.lit(0.0), lambda acc, v: acc + v["x"] / v["u"]).alias("s"))
    count = kinds.groupBy("group").agg(F.sum("n").alias("all"))
    # a mean that lies on the threshold is not below it, however its sum was rounded
    rows = kinds.join(count, "group").join(near, ["group", "kind"], "left")
    mean = F.when(F.col("all") == 1, 1.0).otherwise(F.coalesce("s", F.lit(0.0)) / (F.col("all") - 1))
    low_ones = F.sum(F.when(F.col("m") < outlier - 1e-12, F.col("n")).otherwise(0))
    close = rows.withColumn("m", mean).groupBy("group").agg(F.sum("n").alias("n"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("cohesion"), (low_ones / F.sum("n")).alias("outlier_ratio"))
    squeeze = lambda c: F.upper(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")))
    says = (squeeze("label") != "") & F.contains(squeeze("text"), squeeze("label"))
    told = members.select("group", "item", "text").join(labels, "group", "left").join(rivals.select("item").distinct().withColumn("rival", F.lit(1)), "item", "left")
    told = told.groupBy("group").agg(F.avg(says.cast("int")).alias("label_support"), F.avg(F.coalesce("rival", F.lit(0))).alias("ambiguity"))
    out = close.join(told, "group")
    score = F.greatest(F.lit(0.0), low - F.col("cohesion")) + F.col("outlier_ratio") + F.greatest(F.lit(0.0), weak - F.col("label_support")) + F.col("ambiguity")
    return out.withColumn("score", F.round(score, 6)).withColumns({c: F.round(c, 6) for c in ("cohesion", "outlier_ratio", "label_support", "ambiguity")})


def bounded_recall(candidates: DataFrame, group: str, order: Sequence[Column], per_group: int, total: int) -> DataFrame:
    """Each group's `per_group` best candidates with their rank, of which `total` are taken in turn: all first ones in order
    of the group, then all second ones, and so on. A distributed top-k, no task orders all of them."""
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= per_group)
    return ranked.orderBy("rank", group).limit(total)


def measured_gains(tasks: DataFrame, required: Sequence[str], wins: int = 3) -> DataFrame:
    """(task_id, status, win, gate) for each required task of tasks(task_id, base_correct, base_seconds, base_objects,
    map_correct, map_seconds, map_objects, map_unsupported).

    A task without a whole, plausible measurement is PENDING. It is a win when nothing correct was lost, nothing unsupported
    was claimed, and it took less time or fewer objects. The gate is PASS when all are MEASURED with enough wins; duplicate
    or unexpected tasks make it INVALID.
    """
    spark = tasks.sparkSession
    want = spark.createDataFrame([(r,) for r in required], "task_id string")
    numbers = ("base_seconds", "base_objects", "map_seconds", "map_objects", "map_unsupported")
    whole = F.col("base_correct").isNotNull() & F.col("map_correct").isNotNull()
    for c in numbers:
        whole = whole & F.coalesce(F.col(c) >= 0, F.lit(False))
    win = whole & (F.col("map_correct").cast("int") >= F.col("base_correct").cast("int")) & (F.col("map_unsupported") == 0) & ((F.col("map_seconds") < F.col("base_seconds")) | (F.col("map_objects") < F.col("base_objects")))
    rows = want.join(tasks, "task_id", "left").select("task_id", F.when(whole, "MEASURED").otherwise("PENDING").alias("status"), F.coalesce(win, F.lit(False)).alias("win")).distinct()
    odd = tasks.groupBy("task_id").count().join(want.withColumn("w", F.lit(1)), "task_id", "left").agg(F.count_if((F.col("count") > 1) | F.col("w").isNull()).alias("odd"))
    all_ = rows.agg(F.bool_and(F.col("status") == "MEASURED").alias("all"), F.count_if("win").alias("wins"))
    gate = F.when(F.col("odd") > 0, "INVALID").when(F.col("all") & (F.col("wins") >= wins), "PASS").otherwise("PENDING")
    return rows.join(F.broadcast(odd.join(all_))).select("task_id", "status", "win", gate.alias("gate"))


# ---- trees, snapshots and gates
def tree_paths(nodes: DataFrame) -> DataFrame:
    """(id, path, status) of nodes(id, parent, title): titles from the top down. Ids with several rows are DUPLICATE (the least
    title counts), a parent that is not there makes a top of status MISSING_PARENT, and nodes that no top reaches are in or
    under a CYCLE, without a path."""
    from metaspan.operators.meta import cut

    one = nodes.groupBy("id").agg(F.min(F.struct("title", "parent")).alias("n"), F.count("*").alias("times")).select("id", "n.title", "n.parent", "times")
    one = cut(one)
    have = one.select(F.col("id").alias("parent"), F.lit(True).alias("has"))
    tops = one.join(have, "parent", "left").filter("parent is null or has is null")
    found = wave = cut(tops.select("id", F.array("title").alias("path"), F.col("parent").isNotNull().alias("missing")))
    while not wave.isEmpty():
        up = wave.select(F.col("id").alias("parent"), "path")
        wave = cut(one.join(up, "parent").select("id", F.concat("path", F.array("title")).alias("path"), F.lit(False).alias("missing")))
        found = found.unionByName(wave)
    out = one.join(found, "id", "left")
    status = F.when(F.col("times") > 1, "DUPLICATE").when(F.col("path").isNull(), "CYCLE").when(F.col("missing"), "MISSING_PARENT").otherwise("OK")
    return out.select("id", "path", status.alias("status"))


def catalog_tree(items: DataFrame, key: str, path: str, missing: str = "(no catalogue)") -> DataFrame:
    """(path, level, own, below, last) for every node of the items' paths (arrays): items at the node, and at it or below; items
    without a path stand under `missing`, which is ordered last."""
    p = F.when(F.size(F.coalesce(path, F.array().cast("array<string>"))) == 0, F.array(F.lit(missing))).otherwise(F.col(path))
    rows = items.select(F.col(key).alias("k"), p.alias("p"))
    heads = rows.select("k", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.struct(F.slice("p", F.lit(1), n).alias("path"), (n == F.size("p")).alias("own")))).alias("x"))
    out = heads.groupBy("x.path").agg(F.count_distinct(F.when(F.col("x.own"), F.col("k"))).alias("own"), F.count_distinct("k").alias("below"))
    return out.select("path", F.size("path").alias("level"), "own", "below", (F.element_at("path", 1) == missing).alias("last"))


def snapshot_validation(rows: DataFrame, key: str, declared: int) -> DataFrame:
    """(check, violations, status): empty ids, ids of several rows, and the difference from the declared number of rows."""
    per = rows.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"))
    facts = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.coalesce("k", F.lit("")) == "", F.col("n"))), F.lit(0)).alias("empty"), F.count_if((F.col("n") > 1) & (F.coalesce("k", F.lit("")) != "")).alias("twice"))
    checks = F.array(*[F.struct(F.lit(n).alias("check"), v.cast("long").alias("violations")) for n, v in (("EMPTY_ID", F.col("empty")), ("DUPLICATE_ID", F.col("twice")), ("DECLARED_COUNT", F.abs(F.col("all") - declared)))])
    return facts.select(F.explode(checks).alias("x")).select("x.check", "x.violations", F.when(F.col("x.violations") == 0, "PASS").otherwise("FAIL").alias("status"))


def suite_gate(cases: DataFrame, expected: Sequence[str], before: str = "") -> DataFrame:
    """(observed, exact, status, chain) of one suite's cases(ordinal, case_id, status, sha256), a bounded list: PASS when the cases
    are exactly the expected ones in order and all passed; chain is the SHA-256 over the suite before and the cases."""
    listed = cases.agg(F.array_sort(F.collect_list(F.struct("ordinal", "case_id", "status", "sha256"))).alias("c"))
    ids = F.transform("c", lambda x: x["case_id"])
    exact = ids == F.array(*[F.lit(e) for e in expected]).cast("array<string>")
    good = F.forall("c", lambda x: x["status"] == "PASS") & (F.size("c") > 0)
    chain = F.sha2(F.concat_ws("|", F.lit(before), F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["case_id"], x["status"], x["sha256"])), "|")), 256)
    return listed.select(ids.alias("observed"), exact.alias("exact"), F.when(exact & good, "PASS").otherwise("FAIL").alias("status"), chain.alias("chain"))


# ---- collected sources
def expandable(nodes: DataFrame, allowed: str | None, stop: str, passing: str) -> DataFrame:
    """nodes(node, kind, db) with expand: a table of a known database goes on, unless the database starts with `stop` and is
    not `passing`; with `allowed` only that database goes on. Names compare in lower case."""
    db = F.lower(F.trim(F.coalesce("db", F.lit(""))))
    go = F.contains(F.lower("kind"), F.lit("table")) & (db != "") & (~F.startswith(db, F.lit(stop.lower())) | (db == passing.lower()))
    if allowed:
        go = go & (db == allowed.lower())
    return nodes.withColumn("expand", F.coalesce(go, F.lit(False)))


def source_coverage(sources: dict[str, DataFrame], schema: str, name: str) -> DataFrame:
    """(schema, name, <source> flags, n_sources, elsewhere): which sources hold each object, and whether another schema has
    one of the same name."""
    rows = None
    for s, df in sources.items():
        one = df.select(F.col(schema).alias("schema"), F.col(name).alias("name"), F.lit(s).alias("s"))
        rows = one if rows is None else rows.unionByName(one)
    out = rows.groupBy("schema", "name").agg(*[F.bool_or(F.col("s") == s).alias(s) for s in sources])
    spread = out.groupBy("name").agg(F.count("*").alias("k"))
    return out.join(spread, "name").select("schema", "name", *sources, sum(F.col(s).cast("int") for s in sources).alias("n_sources"), (F.col("k") > 1).alias("elsewhere"))


def mapping_status(probes: DataFrame, naming: DataFrame, fallback: DataFrame) -> DataFrame:
    """(target, source, match) of probes(target, status, source) by naming(target, source) and fallback(target, source): a probe
    that found a source CONFIRMs a name or is CORRECTED against it, else NEW (EXTERNAL outside the named schemas); without
    one the FALLBACK, then the NAMING candidate, else UNKNOWN. A failed probe falls back on names if it was NOT-FOUND."""
    names = naming.groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("names"))
    schemas = naming.agg(F.collect_set(F.element_at(F.split("source", r"\."), 1)).alias("schemas"))
    back = fallback.groupBy("target").agg(F.min("source").alias("back"))
    rows = probes.join(names, "target", "left").join(back, "target", "left").join(F.broadcast(schemas))
    found, named = F.coalesce("source", F.lit("")) != "", F.col("names").isNotNull()
    ok = F.coalesce(F.col("status") == "SUCCESS", F.lit(False))
    ours = F.array_contains("schemas", F.element_at(F.split("source", r"\."), 1))
    match = (
        F.when(~ok, F.when(named & F.contains("status", F.lit("NOT-FOUND")), "NAMING").otherwise("UNKNOWN"))
        .when(~found, F.when(F.col("back").isNotNull(), "FALLBACK").when(named, "NAMING").otherwise("UNKNOWN"))
        .when(F.coalesce(F.array_contains("names", F.col("source")), F.lit(False)), "CONFIRM").when(named, "CORRECTED").when(ours, "NEW").otherwise("EXTERNAL")
    )
    first = F.try_element_at("names", F.lit(1))
    source = F.when(match == "FALLBACK", F.col("back")).when(match == "NAMING", first).when(match == "UNKNOWN", F.lit(None)).otherwise(F.col("source"))
    return rows.select("target", source.alias("source"), match.alias("match"))


def unique_ids(records: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, ids, id, status): RESOLVED with exactly one distinct id that is not empty, AMBIGUOUS with several, else NO_MATCH."""
    i = F.trim(F.col(ident).cast("string"))
    out = records.groupBy(key).agg(F.array_sort(F.collect_set(F.when(i != "", i))).alias("ids"))
    return out.select(key, "ids", F.when(F.size("ids") == 1, F.element_at("ids", 1)).alias("id"), F.when(F.size("ids") == 1, "RESOLVED").when(F.size("ids") > 1, "AMBIGUOUS").otherwise("NO_MATCH").alias("status"))


def seed_scope(seeds: DataFrame, relations: DataFrame, io: DataFrame, gate: str) -> DataFrame:
    """(guid, name, scope, sources, upstream, assets, tasks) of seeds(guid, name, db): relations(guid, source, upstream) and the
    writes of io(task_id, direction, dataset), matched by the last part of the name, as sorted lists joined by `|`."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), "|").alias(c)
    met = relations.groupBy("guid").agg(listed("source"), listed("upstream"))
    tail = F.lower(F.element_at(F.split("dataset", r"\."), -1))
    wrote = io.filter("direction = 'WRITE' and dataset <> ''").select(tail.alias("tail"), F.col("dataset").alias("assets"), F.col("task_id").alias("tasks")).groupBy("tail").agg(listed("assets"), listed("tasks"))
    db = F.lower(F.trim(F.coalesce("db", F.lit(""))))
    scope = F.when(db == gate.lower(), "ALREADY_AT_GATE").when(F.startswith(db, F.lit(gate.lower().split("_")[0] + "_")), "OTHER_GATE").when(db.isin("", "-"), "DB_UNKNOWN").otherwise("CONTINUE")
    out = seeds.withColumn("tail", F.lower("name")).join(met, "guid", "left").join(wrote, "tail", "left")
    empty = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    return out.select("guid", "name", scope.alias("scope"), empty("source", "sources"), empty("upstream", "upstream"), empty("assets", "assets"), empty("tasks", "tasks"))


def merge_bundles(incoming: DataFrame, canonical: DataFrame, replace: bool = False) -> DataFrame:
    """(task_id, action, sha256) of two task indexes (task_id, sql_sha256): an equal hash is kept, or REPLACEd if asked for;
    CONFLICT where hashes differ; tasks of one side are ADDed or KEPT; ids of several rows in a side are DUPLICATE."""
    one = lambda df, c: df.groupBy("task_id").agg(F.min("sql_sha256").alias(c), F.count("*").alias(f"n_{c}"))
    out = one(incoming, "new").join(one(canonical, "old"), "task_id", "full")
    twice = (F.coalesce("n_new", F.lit(0)) > 1) | (F.coalesce("n_old", F.lit(0)) > 1)
    same = F.lit("REPLACE" if replace else "KEEP")
    action = F.when(twice, "DUPLICATE").when(F.col("old").isNull() & F.col("n_old").isNull(), "ADD").when(F.col("n_new").isNull(), "KEEP").when(F.col("new").eqNullSafe(F.col("old")), same).otherwise("CONFLICT")
    return out.select("task_id", action.alias("action"), F.coalesce("new", "old").alias("sha256"))


def family_scan(texts: DataFrame, key: str, text: str, families: dict[str, str]) -> DataFrame:
    """(key, family, hits, first): for each family's pattern how often the text holds it, and its first occurrence."""
    rows = None
    for name, pattern in families.items():
        found = F.regexp_extract_all(text, F.lit(f"(?i)({pattern})"), F.lit(1))
        one = texts.select(F.col(key), F.lit(name).alias("family"), F.size(found).alias("hits"), F.try_element_at(found, F.lit(1)).alias("first")).filter("hits > 0")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def pack_checks(packs: DataFrame, items: DataFrame, known: DataFrame) -> DataFrame:
    """(check, violations, status) of evidence packs(pack_id, declared) and items(pack_id, item_id, ref, text): packs without
    items, counts other than declared, items of no pack, repeated items, refs that known(ref) lacks, and empty texts."""
    counts = items.groupBy("pack_id").agg(F.count("*").alias("n"))
    checks = {
        "EMPTY_PACK": packs.join(counts, "pack_id", "left_anti"),
        "DECLARED_COUNT": packs.join(counts, "pack_id").filter("n <> declared"),
        "UNKNOWN_PACK": items.join(packs, "pack_id", "left_anti"),
        "DUPLICATE_ITEM": items.groupBy("pack_id", "item_id").count().filter("count > 1"),
        "UNKNOWN_REF": items.join(known.select("ref"), "ref", "left_anti"),
        "EMPTY_TEXT": items.filter("trim(coalesce(text, '')) = ''"),
    }
    return M.quality_gates(checks)
