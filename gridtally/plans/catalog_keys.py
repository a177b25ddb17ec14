"""Queries for key rules, filters, limits and set operations (B, C, I, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtally.functions import keys as K
from gridtally.operators import rollups as R
from gridtally.operators import select as S
from gridtally.plans.catalog_rollups import BIN, E, U, SU
from gridtally.plans.registry import query
from gridtally.sources.views import NAME_TOKENS, name_view, page_files, supp_view, table, unit_view, with_views

N = with_views("name_view")


def q(s):
    return "'" + s.replace("'", "''") + "'"


DROP = r"regexp_replace({x}, '^(.*[^./][^/]*)\.[^./]*$', '\1')"
BASE = DROP.format(x="name")


def strip_sql(suffixes, base="b"):
    cases = " ".join(f"when ends_with({base}, {q(s)}) then left({base}, length({base}) - {len(s)})" for s in suffixes)
    return f"case {cases} else {base} end"


def norm_sql(x):
    n = f"lower({DROP.format(x=f'regexp_replace({x}, ' + q('^.*/') + ', ' + q('') + ')')})"
    n = f"regexp_replace({n}, '\\(.*?\\)', '', 'g')"
    n = f"trim(regexp_replace({n}, '[-\\s_]+', '_', 'g'), '_')"
    n = f"regexp_replace({n}, '(_(dapi|merge|roi|mask|fitc|nucleus|rgb|gt|le))+$', '')"
    n = f"replace(replace({n}, 'merge', ''), 'dapi', '')"
    return f"trim(regexp_replace({n}, '__+', '_', 'g'), '_')"


def tok_sql(x):
    return f"list_filter(regexp_split_to_array(lower({x}), '[_\\s]+'), lambda t: t <> '')"


@query("b1_strip_known_suffix", N + f", x as (select name, {BASE} as b from name_view) select name, {strip_sql(K.EXTENDED_SUFFIXES)} as ext_uid, {strip_sql(K.STRICT_SUFFIXES)} as strict_uid from x")
def _(spark, sf):
    return name_view(spark, sf).select("name", K.strip_known_suffix(F.col("name")).alias("ext_uid"), K.strip_known_suffix(F.col("name"), K.STRICT_SUFFIXES).alias("strict_uid"))


@query("b2_normalise_uid", N + f" select name, {norm_sql('name')} as uid from name_view")
def _(spark, sf):
    return name_view(spark, sf).select("name", K.normalise_uid(F.col("name")).alias("uid"))


@query("b3_extract_uid", N + f", x as (select p_partkey, name, {BASE} as b from name_view) select name, case when p_partkey % 2 = 0 then {norm_sql('name')} else {strip_sql(K.EXTENDED_SUFFIXES)} end as uid from x")
def _(spark, sf):
    kind = F.when(F.col("p_partkey") % 2 == 0, "localized").otherwise("counts_only")
    return name_view(spark, sf).select("name", K.extract_uid(F.col("name"), kind).alias("uid"))


@query("b4_tokens", N + f""", x as (select name, {norm_sql('name')} as uid from name_view), t as (select name, uid, {tok_sql('uid')} as toks from x)
 select name, array_to_string(toks, '|') as tokens, list_filter(list_reverse(toks)[1:3], lambda t: t in ('a', 'b'))[1] as side_tag,
 list_filter(toks, lambda t: regexp_full_match(t, '[0-9]+'))[-1] as last_number, regexp_replace(lower(uid), '[^a-z0-9]', '', 'g') as alnum from t""")
def _(spark, sf):
    x = name_view(spark, sf).select("name", K.normalise_uid(F.col("name")).alias("uid"))
    u = F.col("uid")
    return x.select("name", F.array_join(K.tokens(u), "|").alias("tokens"), K.side_tag(u).alias("side_tag"), K.last_number(u).alias("last_number"), K.alnum(u).alias("alnum"))


CANON_SQL = lambda x: f"lower(trim(regexp_replace(regexp_replace(replace(regexp_replace(trim({x}), '_[lL][eE]$', ''), 'control', 'ctrl'), '_bad$', ''), '__+', '_', 'g'), '_'))"


@query("b5_canonical_key", N + f" select name, {CANON_SQL(BASE)} as ckey from name_view")
def _(spark, sf):
    return name_view(spark, sf).select("name", K.canonical_key(K.drop_extension(F.col("name"))).alias("ckey"))


GROUP_CASE = "case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in K.GROUP_ALIASES.items()) + " end"
CANON = {v.lower(): v for v in K.GROUP_ALIASES.values()}
GROUP_LIST = "[" + ", ".join(f"'{k}'" for k in K.GROUP_ALIASES) + "]"


def group_sql(x):
    t = f"list_transform({tok_sql(norm_sql(x))}, lambda t: regexp_replace(t, '[^a-z0-9]', '', 'g'))"
    hit = f"list_filter({t}, lambda t: list_contains({GROUP_LIST}, t))[1]"
    subs = ", ".join(f"case when len(list_filter({t}, lambda t: contains(t, '{k}'))) > 0 then '{v}' end" for k, v in CANON.items())
    return f"coalesce({GROUP_CASE.format(x=hit)}, {subs})"


@query("b6_infer_group", N + f" select name, {group_sql('name')} as grp from name_view")
def _(spark, sf):
    return name_view(spark, sf).select("name", K.infer_group(F.col("name")).alias("grp"))


PREFIX_SQL = lambda x: "case " + " ".join(f"when starts_with(regexp_replace(lower({x}), '[-_]', '', 'g'), '{p}') then '{v}'" for p, v in K.GROUP_PREFIXES) + " else 'UNKNOWN' end"


@query("b7_group_from_prefix", N + f" select name, {PREFIX_SQL('name')} as grp from name_view")
def _(spark, sf):
    return name_view(spark, sf).select("name", K.group_from_prefix(F.col("name")).alias("grp"))


LABEL_CASE = lambda x: f"coalesce(case regexp_replace(upper({x}), '[-_ ]', '', 'g') " + " ".join(f"when '{k}' then '{v}'" for k, v in K.DISPLAY_LABELS.items()) + f" end, trim({x}))"
TOKEN_SQL = "([" + ", ".join(q(t) for t in NAME_TOKENS) + "])[p_size % 7 + 1]"


def part_token():
    return F.element_at(F.array(*[F.lit(t) for t in NAME_TOKENS]), (F.col("p_size") % 7 + 1).cast("int"))


@query("b8_canonical_label", f"select p_partkey, {LABEL_CASE(TOKEN_SQL)} as label, {LABEL_CASE('p_name')} as other from part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", K.canonical_label(part_token()).alias("label"), K.canonical_label(F.col("p_name")).alias("other"))


MODEL_SQL = "(['Peaks (v2)', 'mask threshold', 'THRESHOLD', 'peak mask', 'Other tool'])[p_size % 5 + 1]"


@query("b9_canonical_model", f"with x as (select p_partkey, {MODEL_SQL} as m from part) select p_partkey, case when lower(m) like '%peak%' then 'peaks' when lower(m) like '%mask%' or lower(m) like '%thresh%' then 'threshold mask' else m end as model from x")
def _(spark, sf):
    m = F.element_at(F.array(*[F.lit(v) for v in ["Peaks (v2)", "mask threshold", "THRESHOLD", "peak mask", "Other tool"]]), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", K.canonical_model(m).alias("model"))


COND_UID = "lower(replace(p_name, ' ', '_')) || '_' || lower(p_type) || '_' || p_size || '_' || p_partkey || case when p_partkey % 3 = 0 then '_ab' when p_partkey % 3 = 1 then '_29f' else '' end"


def cond_uid(spark, sf):
    side = F.when(F.col("p_partkey") % 3 == 0, "_ab").when(F.col("p_partkey") % 3 == 1, "_29f").otherwise("")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lower(F.translate("p_name", " ", "_")), F.lit("_"), F.lower("p_type"), F.lit("_"), F.col("p_size").cast("string"), F.lit("_"), F.col("p_partkey").cast("string"), side).alias("uid"),
    )


@query("b10_condition_trailing", f"select p_partkey, regexp_replace({COND_UID}, '_(\\d+)(_[a-z]{{1,2}})?$', '') as cond from part")
def _(spark, sf):
    return cond_uid(spark, sf).select("p_partkey", K.condition_trailing(F.col("uid")).alias("cond"))


@query("b11_condition_between", f"""with x as (select p_partkey, {COND_UID} as uid from part), y as (select *, string_split(uid, '_')[2:] as rest from x),
 z as (select *, list_filter(range(1, len(rest) + 1), lambda i: regexp_full_match(rest[i], '[0-9]+'))[-1] as last from y)
 select p_partkey, case when uid = 'red_widget_economy_28_1_29f' then 'override' else array_to_string(case when last is not null then rest[1:last - 1] when regexp_full_match(rest[-1], '[0-9]+[a-z]') then rest[1:len(rest) - 1] else rest end, '_') end as cond from z""")
def _(spark, sf):
    return cond_uid(spark, sf).select("p_partkey", K.condition_between(F.col("uid"), {"red_widget_economy_28_1_29f": "override"}).alias("cond"))


@query("b12_longest_token_owner", f"""with x as (select {COND_UID} as uid from part), o as (select distinct lower(replace(p_name, ' ', '_')) as token from part union select distinct lower(replace(p_name, ' ', '_')) || '_' || lower(p_type) from part)
 select uid, arg_max(token, length(token)) as owner from x left join o on uid = token or starts_with(uid, token || '_') group by uid""")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.lower(F.translate("p_name", " ", "_")).alias("n"), F.lower("p_type").alias("t"))
    owners = p.select(F.col("n").alias("token")).union(p.select(F.concat_ws("_", "n", "t").alias("token"))).distinct()
    return K.longest_token_owner(cond_uid(spark, sf).select("uid"), "uid", owners)


@query("b13_group_label", """select p_partkey, p_brand || coalesce(' · ' || nullif(concat_ws(' ', case when p_size > 10 then p_type end, case when p_size > 20 then 'IC50' end, case when p_size > 30 then p_size || ' h' end), ''), '') as label from part""")
def _(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", K.group_label(F.col("p_brand"), F.when(s > 10, F.col("p_type")), F.when(s > 20, F.lit("IC50")), F.when(s > 30, s)).alias("label")
    )


WORD_SQL = "(['TRUE', 'no', ' yes ', 'Y', ''])[p_size % 5 + 1]"


@query("b14_as_bool", f"with x as (select p_partkey, {WORD_SQL} as w, case when p_size % 4 = 0 then 'n/a' else cast(p_size % 3 as varchar) end as v from part) select p_partkey, lower(trim(w)) in ('true', '1', 'yes', 'y') as w, coalesce(try_cast(v as double), 0) <> 0 as v from x")
def _(spark, sf):
    w = F.element_at(F.array(*[F.lit(v) for v in ["TRUE", "no", " yes ", "Y", ""]]), (F.col("p_size") % 5 + 1).cast("int"))
    v = F.when(F.col("p_size") % 4 == 0, "n/a").otherwise((F.col("p_size") % 3).cast("string"))
    x = table(spark, sf, "part").select("p_partkey", w.alias("w"), v.alias("v"))
    return K.as_bool(K.as_bool(x, "w"), "v")


@query("b15_density_bin", SU + f" select uid, model, gt_count, {BIN} as density_bin, cast(case when gt_count >= 300 then 4 when gt_count >= 150 then 3 when gt_count >= 50 then 2 when gt_count >= 10 then 1 else 0 end as int) as bin_ord from supp_view")
def _(spark, sf):
    return K.stratify(supp_view(spark, sf).select("uid", "model", "gt_count"), "gt_count")


@query("b16_cut", U + " select uid, model, case when gt_count > 0 and gt_count <= 10 then 'low' when gt_count > 10 and gt_count <= 15 then 'mid' when gt_count > 15 and gt_count <= 20 then 'high' end as band from unit_view")
def _(spark, sf):
    return unit_view(spark, sf).select("uid", "model", K.cut(F.col("gt_count"), [0, 10, 15, 20], ["low", "mid", "high"]).alias("band"))


@query("b17_resolve_path", with_views("page_files") + """, x as (select page_id, case page_id % 5 when 0 then null when 1 then ' ' when 2 then 'NaN' when 3 then '/abs/' || path else path end as rel from page_files)
 select page_id, case when rel is null or trim(rel) = '' or lower(trim(rel)) = 'nan' then '' when starts_with(trim(rel), '/') then trim(rel) else '/data/root/' || trim(rel) end as full_path from x""")
def _(spark, sf):
    k = F.col("page_id") % 5
    rel = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, " ").when(k == 2, "NaN").when(k == 3, F.concat(F.lit("/abs/"), "path")).otherwise(F.col("path"))
    return page_files(spark, sf).select("page_id", K.resolve_path(rel, "/data/root/").alias("full_path"))


@query("b18_retarget", N + " select name, case when ends_with(name, '.tif') then left(name, length(name) - 4) || '.png' else name end as png, case when starts_with(name, 'snu16') then 'SNU' || substr(name, 6) else name end as rooted from name_view")
def _(spark, sf):
    n = F.col("name")
    return name_view(spark, sf).select("name", K.retarget(n, ".tif", ".png").alias("png"), K.retarget(n, "snu16", "SNU", "prefix").alias("rooted"))


@query("b18_retarget_summary", N + " select count(*) filter (where name like '%.tif') as changed, count(*) filter (where name not like '%.tif' and trim(name) <> '') as unchanged, count(*) filter (where trim(name) = '') as empty from name_view")
def _(spark, sf):
    return K.retarget_summary(name_view(spark, sf), "name", ".tif", ".png")


KINDS = [("fr", "french"), ("en", "english"), ("de", "german")]


@query("b19_classify_path", with_views("page_files") + " select page_id, case " + " ".join(f"when list_contains(string_split(lower(path), '/'), '{a}') then '{b}'" for a, b in KINDS) + " else 'other' end as kind from page_files")
def _(spark, sf):
    return page_files(spark, sf).select("page_id", K.classify_path(F.col("path"), KINDS).alias("kind"))


@query("b20_name_problems", """with x as (select page_id, unnest(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda p: p <> '')) as part, generate_subscripts(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda p: p <> ''), 1) as i from pages),
 b as (select *, list_sort(list_distinct(regexp_extract_all(part, '[^A-Za-z0-9!\\-_.*''() ]'))) as bad from x),
 m as (select page_id, i, part, 1 as k, 'characters not for file names: ' || array_to_string(list_transform(bad, lambda c: '''' || c || ''''), ' ') as msg from b where len(bad) > 0
  union all select page_id, i, part, 2, 'blank at the end' from b where rtrim(part) <> part union all select page_id, i, part, 3, 'blank inside' from b where contains(part, ' '))
 select p.page_id, coalesce(string_agg(part || ': ' || msg, '; ' order by i, k), '') as problems from pages p left join m using (page_id) group by p.page_id""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", K.name_problems(F.regexp_replace("url", "^[a-z]+://", "")).alias("problems"))


@query("b22_slug", "select p_partkey, replace(replace(lower(p_name || '-' || p_brand), '-', '_'), ' ', '_') as slug from part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", K.slug(F.concat_ws("-", "p_name", "p_brand")).alias("slug"))


@query("b23_combo_id", "select p_partkey, array_to_string(string_split(p_name, ' '), '__') as combo_id from part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", K.combo_id(F.split("p_name", " ")).alias("combo_id"))


@query("b23_unpack_flat_params", "select p_partkey, 'blur' as fn, 'size__px' as param, p_size as value from part union all select p_partkey, lower(p_type), 'k', p_size + 1 from part")
def _(spark, sf):
    m = F.create_map(F.lit("blur__size__px"), F.col("p_size"), F.concat(F.lower("p_type"), F.lit("__k")), F.col("p_size") + 1, F.lit("plain"), F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", F.explode(K.unpack_flat_params(m)).alias("e")).select("p_partkey", "e.*")


V = "cast((event_id * 37) % 256 as double)"
CH = "[cast(event_id % 256 as double), cast((event_id * 7) % 256 as double), cast((event_id * 13) % 256 as double)]"


@query("b24_intensity_transforms", f"""select event_id, cast(trunc(least(greatest(pow({V} / 255.0, 0.8) * 255.0, 0), 255)) as int) as gamma, cast(trunc(least(greatest(255.0 / (1 + exp(10.0 * (0.5 - {V} / 255.0))), 0), 255)) as int) as sigmoid,
 cast(list_max({CH}) as int) as ch_max, cast(floor(list_sum({CH}) / 3) as int) as ch_mean, cast(trunc(list_sort({CH})[2]) as int) as ch_median, case when {V} >= 128 then 255 else 0 end as thresh from events""")
def _(spark, sf):
    e = F.col("event_id")
    v = ((e * 37) % 256).cast("double")
    ch = F.array((e % 256).cast("double"), ((e * 7) % 256).cast("double"), ((e * 13) % 256).cast("double"))
    return table(spark, sf, "events").select(
        "event_id", K.gamma_transform(v, 0.8).alias("gamma"), K.sigmoid_transform(v).alias("sigmoid"), K.channel_reduce(ch, "max").alias("ch_max"),
        K.channel_reduce(ch, "mean").alias("ch_mean"), K.channel_reduce(ch, "median").alias("ch_median"), K.threshold_transform(v, 128).alias("thresh"),
    )


# ---- C ----------------------------------------------------------------------------------------


@query("c1_filter_split", U + " select uid, model, grp from unit_view where split = 'test' and grp in ('Brand#1', 'Brand#2')")
def _(spark, sf):
    return S.filter_group(S.filter_split(unit_view(spark, sf), "test"), ["Brand#1", "Brand#2"]).select("uid", "model", "grp")


@query("c1_filter_with_roi", "select doc_id, lang from documents where source is not null and trim(source) <> ''")
def _(spark, sf):
    return S.filter_with_roi(table(spark, sf, "documents").select("doc_id", "lang", "source"), "source").select("doc_id", "lang")


def labelled(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 0).alias("clean"))
    return table(spark, sf, "documents").select("doc_id", "lang").join(lab, "doc_id", "left")


@query("c2_filter_passing", "select doc_id, lang from documents left join labels using (doc_id) where coalesce(quality = 1, true) and coalesce(toxic = 0, true)")
def _(spark, sf):
    return S.filter_passing(labelled(spark, sf), ["good", "clean"]).select("doc_id", "lang")


@query("c3_filter_consistent", "select doc_id, lang from documents left join labels using (doc_id) where coalesce(quality = 1, false)")
def _(spark, sf):
    return S.filter_consistent(labelled(spark, sf), "good").select("doc_id", "lang")


@query("c4_bucket_by_group", N + f", g as (select coalesce({group_sql('name')}, 'UNKNOWN') as grp, name as uid from name_view) select grp, uid, count(*) over (partition by grp) as n_in_group from g")
def _(spark, sf):
    return S.bucket_by_group(name_view(spark, sf), "name", K.infer_group(F.col("name")), "UNKNOWN")


@query("c5_select_subset", """with r as (select 'o_' || o_orderkey as path, o_custkey as uid, o_orderpriority as section, o_orderstatus as grp from orders),
 u as (select distinct grp, uid from r where section in ('1-URGENT', '2-HIGH')), t as (select grp, uid from u qualify row_number() over (partition by grp order by uid) <= 50)
 select distinct path, uid, section, grp from r where (uid in (select uid from t) and section <> '5-LOW') or section = '4-NOT SPECIFIED'""")
def _(spark, sf):
    r = table(spark, sf, "orders").select(
        F.concat(F.lit("o_"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("section"), F.col("o_orderstatus").alias("grp")
    )
    s = F.col("section")
    return S.select_subset(r, s.isin("1-URGENT", "2-HIGH"), "grp", "uid", "path", 50, s != "5-LOW", s == "4-NOT SPECIFIED").select("path", "uid", "section", "grp")


@query("c6_scope_filter", "select o_orderkey, o_custkey from orders qualify count(*) over (partition by o_custkey) >= 12")
def _(spark, sf):
    return S.scope_filter(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 12)


# ---- I ----------------------------------------------------------------------------------------


@query("i1_top_k_models", U + f" select grp || '/' || model as model, avg(abs({E})) as count_mae from unit_view group by 1 order by 2, 1 limit 3")
def _(spark, sf):
    x = unit_view(spark, sf).withColumn("ae", F.abs(F.col("pred_count") - F.col("gt_count")).cast("double"))
    mae = x.groupBy(F.concat_ws("/", "grp", "model").alias("model")).agg(F.avg("ae").alias("count_mae"))
    return S.top_k_models(mae, 3)


@query("i2_worst_cases", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 15")
def _(spark, sf):
    return S.worst_cases(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("i3_preview_violations", "select l_orderkey, l_linenumber, l_discount, l_tax, l_partkey from lineitem where l_discount < l_tax order by l_orderkey, l_linenumber, l_partkey limit 10")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_partkey")
    return S.preview_violations(li, F.col("l_discount") < F.col("l_tax"), ["l_orderkey", "l_linenumber", "l_partkey"])


@query("i4_representative_pick", U + """, m as (select grp, quantile_cont(cast(gt_count as double), 0.5) as group_median from unit_view where model = 'A' group by grp)
 select u.grp, uid, gt_count, group_median, abs(gt_count - group_median) as gap from unit_view u join m on u.grp = m.grp where model = 'A'
 qualify row_number() over (partition by u.grp order by abs(gt_count - group_median), gt_count, uid) = 1""")
def _(spark, sf):
    return S.representative_pick(unit_view(spark, sf).where("model = 'A'"), "grp", "gt_count", "uid")


# ---- J ----------------------------------------------------------------------------------------


@query("j1_append_truth_series", U + " select uid, model, pred_count, gt_count from unit_view union all select uid, 'truth', gt_count, gt_count from unit_view where model = 'A'")
def _(spark, sf):
    return S.append_truth_series(unit_view(spark, sf).select("uid", "model", "pred_count", "gt_count"), "A")


for _mode, _op in (("union", "union"), ("intersection", "intersect"), ("only_a", "except"), ("only_b", None)):
    _a, _b = "select doc_id as k from documents where lang = 'en'", "select doc_id as k from labels"
    _sql = f"{_a} {_op} {_b}" if _op else f"{_b} except {_a}"

    def _ju(spark, sf, mode=_mode):
        a = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("k"))
        return S.key_universe(a, table(spark, sf, "labels").select(F.col("doc_id").alias("k")), mode)

    query(f"j2_key_universe_{_mode}", _sql)(_ju)


@query("j3_overlaps", """with a as (select distinct doc_id as k from documents where lang = 'en'), b as (select distinct doc_id as k from labels), c as (select distinct doc_id as k from documents where n_chars > 2000)
 select 'en' as a, 'labelled' as b, (select count(*) from a join b using (k)) as n_shared union all select 'en', 'long', (select count(*) from a join c using (k)) union all select 'labelled', 'long', (select count(*) from b join c using (k))""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    lists = {"en": d.where("lang = 'en'").select("doc_id"), "labelled": table(spark, sf, "labels").select("doc_id"), "long": d.where("n_chars > 2000").select("doc_id")}
    return S.overlaps(lists, "doc_id")


@query("j4_set_diff_report", """with a as (select distinct doc_id as k from documents where lang = 'en'), b as (select distinct doc_id as k from labels),
 t as (select coalesce(a.k, b.k) as k, case when a.k is null then 'only_b' when b.k is null then 'only_a' else 'both' end as w from a full join b on a.k = b.k),
 r as (select *, row_number() over (partition by w order by k) as rn from t)
 select w as "where", count(*) as n, string_agg(cast(k as varchar), ', ' order by cast(k as varchar)) filter (where rn <= 5) as examples from r group by w""")
def _(spark, sf):
    a = table(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    return S.set_diff_report(a, table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("j5_concat_tidy", "select doc_id, lang, cast(null as int) as quality from documents union all select doc_id, null, quality from labels")
def _(spark, sf):
    return S.concat_tidy([table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality")])


@query("j6_melt", U + " select uid, model, variable, value from unit_view cross join lateral (values ('obj_tp', obj_tp), ('obj_fp', obj_fp), ('obj_fn', obj_fn)) as v(variable, value)")
def _(spark, sf):
    return S.melt(unit_view(spark, sf), ["uid", "model"], ["obj_tp", "obj_fp", "obj_fn"])
