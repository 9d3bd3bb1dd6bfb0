"""Pair features of candidate pairs: one projection over two gathered records, window context per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import similarity as S
from ledgerloom.functions import text as T
from ledgerloom.operators import keys as K

#: Fixed names: the columns of each family, for choosing feature sets.
FAMILIES = {
    "name": ["name_ratio", "name_norm_ratio", "name_lev", "name_dl", "name_jaro", "name_jw", "name_tset", "name_tsort", "name_partial", "name_prefix", "name_len_ratio", "name_char3_cos", "name_empty_l", "name_empty_r"],
    "token": ["name_tok_jacc", "name_tok_contain", "name_wjacc", "name_shared_idf_sum", "name_shared_idf_max", "name_miss_idf_max_l", "name_miss_idf_max_r", "name_freq_l", "name_freq_r", "name_ntok_l", "name_ntok_r"],
    "number": ["name_num_state", "name_num_eq", "name_num_conflict", "name_num_jacc", "addr_num_jacc", "addr_num_conflict", "house_eq", "house_conflict", "house_absdiff", "conflict_count"],
    "address": ["addr_ratio", "addr_tset", "addr_partial", "addr_char3_cos", "addr_tok_jacc", "addr_wjacc", "addr_shared_idf_max", "addr_miss_idf_max_l", "addr_miss_idf_max_r", "street_ratio", "region_eq", "region_conflict", "postcode_eq", "postcode_conflict", "addr_state"],
    "other": ["is_s3", "legal_state", "legal_eq", "legal_conflict", "phone_eq", "phone_conflict", "domain_eq", "domain_conflict"],
    "extra": ["x_join_eq", "x_join_ratio", "x_join_partial", "x_acr", "x_skel_tset", "x_house_eq", "x_house_trunc", "x_addrnum_eq", "x_addrnum_jacc", "x_native_l", "x_native_r"],
    "retrieval": ["score", "score_all", "score_name", "score_addr", "rr_all", "rr_name", "rr_addr", "rrf", "n_passes"],
    "context": ["n_cand_ctx", "score_rank", "score_gap_best", "score_top2_gap", "score_z", "name_ratio_rank", "name_ratio_gap_best", "n_name_hi", "wjacc_gap_best", "addr_ratio_gap_best"],
    "dense": ["dense_cos", "dense_rank", "dense_gap_best"],
    "extra_context": ["x_house_eq_other", "x_addr_c3_gap_best", "x_street_gap_best", "x_join_ratio_gap_best", "x_skel_gap_best"],
}


def feature_set(*families: str) -> list[str]:
    """The families' columns in order, each once."""
    return list(dict.fromkeys(c for f in families for c in FAMILIES[f]))


def record_view(records: DataFrame) -> DataFrame:
    """Cleaned records with what comparisons need: token sets, numbers, street, phone, domain, joined name, initials, skeleton."""
    none = F.array().cast("array<string>")
    words = lambda c: F.array_distinct(F.filter(F.split(F.replace(F.col(c), F.lit(","), F.lit(" ")), " +"), lambda t: t != ""))
    name_words = F.transform(F.filter(F.split("name_core", " +"), lambda t: t != ""), K.undo_leet)
    raw = F.lower(F.concat_ws(" ", "business_name", "business_address"))
    phone = F.regexp_replace(F.regexp_extract(raw, f"({T.PHONE})", 1), r"\D", "")
    address_numbers = F.filter(F.flatten(F.transform(F.filter(F.split(F.replace(F.col("addr_norm"), F.lit(","), F.lit(" ")), " +"), lambda t: t != ""), K.address_tokens)), lambda t: t.rlike("^[0-9]+$"))
    return records.withColumns(
        {
            "name_tokens": words("name_core"),
            "addr_tokens": words("addr_norm"),
            "street": F.coalesce(F.get(F.split("addr_norm", ","), F.lit(0)), F.lit("")),
            "house_int": F.expr("try_cast(nullif(regexp_extract(house_no, '^([0-9]{1,7})', 1), '') as bigint)"),
            "name_nums": F.array_distinct(F.regexp_extract_all("name_core", F.lit(r"(\d+)"), F.lit(1))),
            "addr_nums": F.array_distinct(F.regexp_extract_all("addr_norm", F.lit(r"(\d+[a-z]?)"), F.lit(1))),
            "phone": F.when(F.length(phone) >= 7, F.right(phone, F.lit(10))).otherwise(""),
            "domain": F.regexp_extract(F.lower("business_name"), T.DOMAIN, 1),
            "joined": F.array_join(name_words, ""),
            "acronym": F.when(F.size(name_words) >= 2, F.array_join(F.transform(name_words, lambda t: F.substring(t, 1, 1)), "")).otherwise(""),
            "skeletons": F.array_join(F.transform(F.filter(name_words, lambda t: (F.length(t) >= 4) & ~t.rlike("^[0-9]+$")), K.skeleton), " "),
            "house_plain": F.regexp_extract("house_no", r"^0*(\d{1,7})", 1),
            "plain_nums": F.coalesce(F.array_distinct(address_numbers), none),
            "native": F.concat_ws(" ", "business_name", "business_address").rlike(r"[^\x00-\x7f]").cast("int"),
        }
    )


def token_idf(pool: DataFrame, column: str) -> DataFrame:
    """(country, token, idf) of a token-set column over the whole pool: ln((n + 1) / (df + 1)), without the 1 of retrieval."""
    n = pool.groupBy("country").agg(F.count("*").alias("n"))
    df = pool.select("country", F.explode(column).alias("token")).groupBy("country", "token").agg(F.count("*").alias("df"))
    return df.join(n, "country").select("country", "token", F.ln((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def _weights(records: DataFrame, idf: DataFrame, column: str, name: str) -> DataFrame:
    """(entity_id, ``name``) for each id: a map of its tokens to their weights, empty without tokens."""
    tokens = records.select("entity_id", "country", F.explode_outer(column).alias("token")).distinct().join(idf, ["country", "token"], "left")
    pair = F.when(F.col("token").isNotNull(), F.struct("token", F.coalesce("idf", F.lit(0.0)).alias("w")))
    once = tokens.groupBy("entity_id", "token").agg(F.max(pair).alias("pair"))
    return once.groupBy("entity_id").agg(F.map_from_entries(F.collect_list("pair")).alias(name))


def weighted_overlap(pairs: DataFrame, records: DataFrame, idf: DataFrame, column: str, prefix: str, pool: DataFrame | None = None) -> DataFrame:
    """(q, p, <prefix>_wjacc, _shared_idf_sum, _shared_idf_max, _miss_idf_max_l, _miss_idf_max_r) of a token-set column, a row for
    each pair: null where a side has no tokens.  Tokens of repeated ids count once; an unknown id fails.

    ``records`` has both sides, or the left one only if ``pool`` has the right one.  Token weights are joined to records once, so
    pairs carry maps of tokens to weights and no posting is joined again."""
    left = _weights(records, idf, column, "l").withColumnRenamed("entity_id", "q")
    right = (_weights(pool, idf, column, "r") if pool is not None else left.withColumnRenamed("l", "r").withColumnRenamed("q", "entity_id")).withColumnRenamed("entity_id", "p")
    both = pairs.select("q", "p").join(left, "q", "left").join(right, "p", "left")
    both = both.withColumns({c: F.coalesce(c, F.raise_error(F.concat(F.lit("no record of id "), F.col(i).cast("string")))) for c, i in (("l", "q"), ("r", "p"))})
    values = lambda m, keys: F.transform(keys, lambda k: m[k])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    l, r = F.col("l"), F.col("r")
    lk, rk = F.map_keys(l), F.map_keys(r)
    shared = F.array_intersect(lk, rk)
    s, a, b = total(values(l, shared)), total(F.map_values(l)), total(F.map_values(r))
    most = lambda m, keys: F.coalesce(F.array_max(values(m, keys)), F.lit(0.0))
    full = (F.size(l) > 0) & (F.size(r) > 0)
    columns = {"wjacc": F.try_divide(s, a + b - s), "shared_idf_sum": s, "shared_idf_max": most(l, shared), "miss_idf_max_l": most(l, F.array_except(lk, rk)), "miss_idf_max_r": most(r, F.array_except(rk, lk))}
    return both.select("q", "p", *[F.round(F.when(full, c), 6).alias(f"{prefix}_{n}") for n, c in columns.items()])


def pair_features(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Features of pairs (q, p, ...) of cleaned records, by the two records alone; an id that isn't there fails."""
    ql, pr = record_view(queries), record_view(pool)
    names = pool.groupBy("country", "name_core").agg(F.count("*").alias("n")).where("name_core != ''")
    freq = lambda d: d.join(names, ["country", "name_core"], "left").withColumn("freq", F.when(F.col("name_core") != "", F.log1p(F.coalesce("n", F.lit(0))))).drop("n")
    ql, pr = freq(ql), freq(pr)
    keep = ["entity_id", "name_core", "name_norm", "addr_norm", "street", "legal_form", "region", "postcode", "house_no", "house_int", "name_tokens", "addr_tokens", "name_nums", "addr_nums", "phone", "domain", "joined", "acronym", "skeletons", "house_plain", "plain_nums", "native", "freq"]
    left = ql.select(*[F.col(c).alias(f"l_{c}") for c in keep]).withColumnRenamed("l_entity_id", "q")
    right = pr.select(*[F.col(c).alias(f"r_{c}") for c in keep]).withColumnRenamed("r_entity_id", "p")
    out = pairs.join(left, "q", "left").join(right, "p", "left")
    known = {f"{s}_name_core": F.coalesce(f"{s}_name_core", F.raise_error(F.concat(F.lit("no record of id "), F.col(i).cast("string")))) for s, i in (("l", "q"), ("r", "p"))}
    out = out.withColumns(known)
    for column, kernels in (("name_core", ["ratio", "damerau", "jaro", "jaro_winkler", "token_set", "token_sort", "partial", "trigram"]), ("name_norm", ["ratio"]), ("addr_norm", ["ratio", "token_set", "partial", "trigram"]), ("street", ["ratio"]), ("joined", ["ratio", "partial"]), ("skeletons", ["token_set"])):
        out = S.on_distinct(out, f"l_{column}", f"r_{column}", kernels)
    l, r = lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}")
    pair = lambda f, c: f(l(c), r(c))
    trunc = (l("house_plain") != r("house_plain")) & (l("house_plain").startswith(r("house_plain")) | r("house_plain").startswith(l("house_plain")) | l("house_plain").endswith(r("house_plain")) | r("house_plain").endswith(l("house_plain")))
    acronym = ((l("acronym") != "") & (r("joined") == l("acronym"))) | ((r("acronym") != "") & (l("joined") == r("acronym")))
    columns: dict[str, Column] = {
        "name_ratio": F.col("l_name_core_ratio"), "name_norm_ratio": F.col("l_name_norm_ratio"), "name_lev": pair(S.levenshtein_similarity, "name_core"),
        "name_dl": F.col("l_name_core_damerau"), "name_jaro": F.col("l_name_core_jaro"), "name_jw": F.col("l_name_core_jaro_winkler"),
        "name_tset": F.col("l_name_core_token_set"), "name_tsort": F.col("l_name_core_token_sort"), "name_partial": F.col("l_name_core_partial"),
        "name_prefix": pair(S.prefix_ratio, "name_core"), "name_len_ratio": pair(S.length_ratio, "name_core"), "name_char3_cos": F.col("l_name_core_trigram"),
        "name_empty_l": (l("name_core") == "").cast("int"), "name_empty_r": (r("name_core") == "").cast("int"), "is_s3": F.col("p").cast("string").startswith("S3").cast("int"),
        "name_tok_jacc": pair(S.jaccard, "name_tokens"), "name_tok_contain": pair(S.containment, "name_tokens"), "addr_tok_jacc": pair(S.jaccard, "addr_tokens"),
        "name_freq_l": l("freq"), "name_freq_r": r("freq"), "name_ntok_l": F.size(l("name_tokens")), "name_ntok_r": F.size(r("name_tokens")),
        "name_num_state": pair(S.set_state, "name_nums"), "name_num_eq": pair(S.set_equal, "name_nums"), "name_num_conflict": pair(S.set_conflict, "name_nums"), "name_num_jacc": pair(S.jaccard, "name_nums"),
        "addr_num_jacc": pair(S.jaccard, "addr_nums"), "addr_num_conflict": pair(S.set_conflict, "addr_nums"),
        "house_eq": pair(S.equal, "house_no"), "house_conflict": pair(S.conflict, "house_no"), "house_absdiff": F.log1p(F.abs(l("house_int") - r("house_int"))),
        "addr_ratio": F.col("l_addr_norm_ratio"), "addr_tset": F.col("l_addr_norm_token_set"), "addr_partial": F.col("l_addr_norm_partial"), "addr_char3_cos": F.col("l_addr_norm_trigram"), "street_ratio": F.col("l_street_ratio"),
        "region_eq": pair(S.equal, "region"), "region_conflict": pair(S.conflict, "region"), "postcode_eq": pair(S.equal, "postcode"), "postcode_conflict": pair(S.conflict, "postcode"),
        "legal_state": pair(S.state, "legal_form"), "legal_eq": pair(S.equal, "legal_form"), "legal_conflict": pair(S.conflict, "legal_form"), "addr_state": pair(S.state, "addr_norm"),
        "phone_eq": pair(S.equal, "phone"), "phone_conflict": pair(S.conflict, "phone"), "domain_eq": pair(S.equal, "domain"), "domain_conflict": pair(S.conflict, "domain"),
        "x_join_eq": pair(S.equal, "joined"), "x_join_ratio": F.col("l_joined_ratio"), "x_join_partial": F.col("l_joined_partial"),
        "x_acr": F.when(pair(S.present, "joined") & ((l("acronym") != "") | (r("acronym") != "")), acronym.cast("int")), "x_skel_tset": F.col("l_skeletons_token_set"),
        "x_house_eq": pair(S.equal, "house_plain"), "x_house_trunc": F.when(pair(S.present, "house_plain"), trunc.cast("int")),
        "x_addrnum_eq": pair(S.set_equal, "plain_nums"), "x_addrnum_jacc": pair(S.jaccard, "plain_nums"), "x_native_l": l("native"), "x_native_r": r("native"),
    }
    out = out.withColumns(columns)
    out = out.withColumn("conflict_count", sum(F.coalesce(c, F.lit(0)) for c in ("house_conflict", "name_num_conflict", "postcode_conflict", "addr_num_conflict")))
    return out.select(*pairs.columns, *columns, "conflict_count")


def retrieval_features(wide: DataFrame, names: tuple[str, ...] = ("all", "name", "addr")) -> DataFrame:
    """Reciprocal ranks (0 where a pass didn't find the pair), their fusion, and the number of passes."""
    rr = {f"rr_{n}": F.coalesce(1.0 / F.col(f"rank_{n}"), F.lit(0.0)) for n in names}
    rrf = sum(F.coalesce(1.0 / (60 + F.col(f"rank_{n}")), F.lit(0.0)) for n in names)
    return wide.withColumns(rr | {"rrf": rrf, "n_passes": sum(F.col(f"rank_{n}").isNotNull().cast("int") for n in names)})


def gap_to_best(column: str, w) -> Column:
    v = F.coalesce(F.col(column), F.lit(-1.0))
    return v - F.max(v).over(w)


def context(pairs: DataFrame, score: str = "score", gaps: dict[str, str] | None = None, ranks: dict[str, str] | None = None, high: dict[str, str] | None = None) -> DataFrame:
    """``pairs`` (q, p, score) with the place of each candidate among its query's: rank, gaps and z-score; ``gaps``, ``ranks`` and
    ``high`` name further columns by the one they compare (missing values count as -1)."""
    w = Window.partitionBy("q")
    rank = F.row_number().over(w.orderBy(F.desc(score), "p"))
    out = pairs.withColumn("score_rank", rank)
    best, second = F.max(score).over(w), F.coalesce(F.max(F.when(F.col("score_rank") == 2, F.col(score))).over(w), F.lit(0.0))
    spread = F.coalesce(F.stddev_samp(score).over(w), F.lit(0.0))
    z = (F.col(score) - F.avg(score).over(w)) / (spread + 1e-6)
    columns = {"n_cand_ctx": F.count("*").over(w), "score_gap_best": F.col(score) - best, "score_top2_gap": best - second, "score_z": F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z))}
    columns |= {new: gap_to_best(c, w) for new, c in (gaps or {}).items()}
    columns |= {new: F.rank().over(w.orderBy(F.desc(F.coalesce(F.col(c), F.lit(-1.0))))) for new, c in (ranks or {}).items()}
    columns |= {new: F.sum((F.coalesce(F.col(c), F.lit(-1.0)) >= 0.9).cast("int")).over(w) for new, c in (high or {}).items()}
    return out.withColumns(columns)


def others_exact(pairs: DataFrame, column: str = "x_house_eq") -> Column:
    """Whether another candidate of the query has a 1 in ``column``."""
    one = (F.coalesce(F.col(column), F.lit(0)) == 1).cast("int")
    return ((F.sum(one).over(Window.partitionBy("q")) - one) > 0).cast("int")


#: Columns that compare a candidate with the query's others, by those that they compare.
GAPS = {"name_ratio_gap_best": "name_ratio", "wjacc_gap_best": "name_wjacc", "addr_ratio_gap_best": "addr_ratio", "x_addr_c3_gap_best": "addr_char3_cos", "x_street_gap_best": "street_ratio", "x_join_ratio_gap_best": "x_join_ratio", "x_skel_gap_best": "x_skel_tset"}


def dense(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` with dense_cos, dense_rank and dense_gap_best by ``vectors`` (entity_id, embedding); null without a vector."""
    side = lambda i, c: vectors.select(F.col("entity_id").alias(i), F.col("embedding").alias(c))
    out = pairs.join(side("q", "_l"), "q", "left").join(side("p", "_r"), "p", "left").withColumn("dense_cos", S.dense_cosine(F.col("_l"), F.col("_r")))
    w = Window.partitionBy("q")
    have = F.col("dense_cos").isNotNull()
    rank = F.when(have, F.rank().over(w.orderBy(F.desc_nulls_last("dense_cos"))))
    return out.withColumn("dense_rank", rank).withColumn("dense_gap_best", F.col("dense_cos") - F.max("dense_cos").over(w)).select(*pairs.columns, "dense_cos", "dense_rank", "dense_gap_best")


def full_table(pairs: DataFrame, queries: DataFrame, pool: DataFrame, vectors: DataFrame | None = None, names: tuple[str, ...] = ("all", "name", "addr")) -> DataFrame:
    """All families' columns of candidate ``pairs`` (q, p, score, and score_<pass> and rank_<pass> of a wide retrieval) of cleaned records;
    those of ``dense`` need ``vectors``."""
    out = pair_features(pairs, queries, pool)
    ql, pr = record_view(queries), record_view(pool)
    for column, prefix in (("name_tokens", "name"), ("addr_tokens", "addr")):
        out = out.join(weighted_overlap(pairs, ql, token_idf(pr, column), column, prefix, pr), ["q", "p"])
    out = context(retrieval_features(out, names), gaps=GAPS, ranks={"name_ratio_rank": "name_ratio"}, high={"n_name_hi": "name_ratio"})
    out = out.withColumn("x_house_eq_other", others_exact(out))
    return dense(out, vectors) if vectors is not None else out


def require_all(pairs: DataFrame, records: DataFrame, side: str) -> DataFrame:
    """Ids of ``side`` of the pairs that no record has; empty if all is well."""
    return pairs.select(F.col(side).alias("entity_id")).distinct().join(records.select("entity_id"), "entity_id", "left_anti")
