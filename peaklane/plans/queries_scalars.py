"""Scalar functions (C), generators (T), the modification dimension (D) and batch scoring (X) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from peaklane.functions import registry as rg
from peaklane.functions import scalars as sc
from peaklane.functions.constants import RESIDUE_MASS
from peaklane.operators import generate as gen
from peaklane.operators import scoring
from peaklane.plans import tables as tb
from peaklane.plans.registry import query

PROTON = 1.00727646688


@query("c01_mz", f"SELECT p_partkey, round((p_retailprice + (p_size % 4 + 1) * {PROTON}) / (p_size % 4 + 1), 5) AS mz FROM part")
def _(spark, t):
    return t("part").select("p_partkey", F.round(sc.mz("p_retailprice", F.col("p_size") % 4 + 1), 5).alias("mz"))


@query("c02_mass_error", "SELECT p_partkey, round((p_retailprice - (900 + p_size)) / (900 + p_size) * 1e6, 3) AS ppm, round(p_retailprice - (900 + p_size), 5) AS abs FROM part")
def _(spark, t):
    theory = F.lit(900) + F.col("p_size")
    return t("part").select("p_partkey", F.round(sc.mass_error("p_retailprice", theory), 3).alias("ppm"), F.round(sc.mass_error("p_retailprice", theory, False), 5).alias("abs"))


@query("c03_tolerance_range", "SELECT p_partkey, round(p_retailprice / (1 + 20 / 1e6), 6) AS lower, round(p_retailprice / (1 - 20 / 1e6), 6) AS upper FROM part")
def _(spark, t):
    return t("part").select("p_partkey", sc.tolerance_range("p_retailprice", 20).alias("r")).select("p_partkey", F.round("r.lower", 6).alias("lower"), F.round("r.upper", 6).alias("upper"))


@query("c04_window_id", "SELECT p_partkey, floor((p_retailprice - 6.0) * 10 + 0.5)::BIGINT || '_' || floor((p_retailprice + 6.0) * 10 + 0.5)::BIGINT AS id FROM part")
def _(spark, t):
    return t("part").select("p_partkey", sc.window_id("p_retailprice", 12.0).alias("id"))


@query("c05_mz_bin", "SELECT p_partkey, floor((p_retailprice - 900) / 0.05 + 0.5)::BIGINT AS bin FROM part")
def _(spark, t):
    return t("part").select("p_partkey", sc.mz_bin("p_retailprice", 900).alias("bin"))


@query("c06_minutes_and_window", f"SELECT user_id, round(max(sec) / 60.0, 4) AS minutes, CASE WHEN (max(sec) - min(sec)) / 86400.0 <= 27 THEN 0.5 WHEN (max(sec) - min(sec)) / 86400.0 <= 29 THEN 1.0 ELSE 1.5 END AS win FROM ({tb.EVENTS_SQL}) GROUP BY user_id")
def _(spark, t):
    span = tb.events(t).groupBy("user_id").agg(F.min("sec").alias("a"), F.max("sec").alias("b"))
    days = (F.col("b") - F.col("a")) / 86400
    scaled = F.when(days <= 27, 30).when(days <= 29, 60).otherwise(61)
    return span.select("user_id", F.round(sc.to_minutes("b", "second"), 4).alias("minutes"), sc.auto_rt_window(F.lit(0), scaled).alias("win"))


@query("c07_reverse_inner", f"SELECT DISTINCT pep AS peptide, pep[1] || reverse(pep[2:length(pep)-1]) || pep[length(pep)] AS reversed FROM ({tb.PEPTIDES_SQL})")
def _(spark, t):
    return tb.peptides(t).select("peptide").distinct().withColumn("reversed", sc.reverse_inner("peptide"))


@query("c08_primary_accession", "SELECT page_id, string_split(replace(url, '/', ' / '), ' / ')[1] AS first, CASE WHEN len(string_split(replace(url, '?', '|'), '|')) > 1 THEN string_split(replace(url, '?', '|'), '|')[2] ELSE url END AS token FROM pages")
def _(spark, t):
    return t("pages").select("page_id", sc.primary_accession(F.replace("url", F.lit("/"), F.lit(" / "))).alias("first"), sc.accession_token(F.replace("url", F.lit("?"), F.lit("|"))).alias("token"))


@query("c09_keys", "SELECT l_orderkey, l_partkey, l_linenumber, l_partkey || '|' || l_linenumber AS form, (l_partkey || '|' || l_linenumber) || ':' || l_suppkey AS pair, l_partkey || '|' || l_linenumber AS a FROM lineitem")
def _(spark, t):
    form = sc.form_key(F.col("l_partkey").cast("string"), "l_linenumber")
    pair = sc.pair_key(form, F.col("l_suppkey").cast("string"))
    return t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", form.alias("form"), pair.alias("pair"), sc.split_pair(pair)["a"].alias("a"))


@query("c10_parse_title", "SELECT page_id, url AS file, page_id::INT AS scan, 2 AS charge FROM pages")
def _(spark, t):
    title = F.concat_ws(":", "url", F.col("page_id").cast("string"), F.lit("2"))
    return t("pages").select("page_id", sc.parse_title(title).alias("p")).select("page_id", "p.file", "p.scan", "p.charge")


@query("c11_mod_string", f"SELECT doc_id, pep AS peptide, CASE WHEN pep LIKE '%M%' THEN 'Oxidation@' || instr(pep, 'M') || '[15.99]' ELSE '' END AS mods FROM ({tb.PEPTIDES_SQL})")
def _(spark, t):
    site = F.instr("peptide", "M")
    mods = F.when(site > 0, F.array(F.struct(F.lit("Oxidation").alias("name"), site.alias("site"), F.lit("15.99").alias("mass")))).otherwise(F.array().cast("array<struct<name:string,site:int,mass:string>>"))
    return tb.peptides(t).select("doc_id", "peptide", sc.mod_string(mods).alias("mods"))


@query("c12_parse_unimod", f"SELECT doc_id, pep AS peptide, pep AS stripped, len(regexp_extract_all(pep, '[MC]'))::INT AS n_mods, coalesce(nullif(instr(pep, 'M'), 0)::INT, 0) AS first_m FROM ({tb.PEPTIDES_SQL})")
def _(spark, t):
    marked = F.regexp_replace("peptide", "([MC])", "$1(UniMod:4)")
    rows = tb.peptides(t).select("doc_id", "peptide", sc.strip_unimod(marked).alias("stripped"), sc.parse_unimod(marked).alias("m"))
    first = F.array_min(F.map_keys(F.map_filter("m", lambda k, v: v.startswith("M"))))
    return rows.select("doc_id", "peptide", "stripped", F.size("m").alias("n_mods"), F.coalesce(first, F.lit(0)).alias("first_m"))


def _oxidised():
    return F.transform(F.filter(F.transform(sc.residues("peptide"), lambda r, i: F.struct(F.when(r == "M", "Oxidation").when(r == "C", "Carbamidomethyl").alias("name"), (i + 1).alias("site"))), lambda m: m["name"].isNotNull()), lambda m: m)


@query("c13_render_modified", f"SELECT doc_id, pep AS peptide, replace(replace(pep, 'M', 'M[15.99491461956]'), 'C', 'C[57.02146372057]') AS mass FROM ({tb.PEPTIDES_SQL})")
def _(spark, t):
    shown = sc.render_modified("peptide", _oxidised(), {"Oxidation": "15.99491461956", "Carbamidomethyl": "57.02146372057"}, "mass")
    return tb.peptides(t).select("doc_id", "peptide", shown.alias("mass"))


@query("c14_encode_modified", f"SELECT doc_id, pep AS peptide, '-' || replace(pep, 'M', '1') || '-' AS code FROM ({tb.PEPTIDES_SQL})")
def _(spark, t):
    return tb.peptides(t).select("doc_id", "peptide", sc.encode_modified("peptide", _oxidised(), {"Oxidation": "1"}).alias("code"))


@query("c15_residue_codes", f"SELECT doc_id, pep AS peptide, array_to_string(list_concat([0], list_transform(string_split(pep, ''), lambda c: ascii(c) - 64), [0]), ',') AS codes FROM ({tb.PEPTIDES_SQL})")
def _(spark, t):
    return tb.peptides(t).select("doc_id", "peptide", F.array_join(sc.residue_codes("peptide").cast("array<string>"), ",").alias("codes"))


@query("c16_formula_counts", "SELECT p_partkey, p_size AS c, p_size + 2 AS h, 3 AS unknown FROM part")
def _(spark, t):
    formula = F.concat(F.lit("C("), F.col("p_size").cast("string"), F.lit(")H("), (F.col("p_size") + 2).cast("string"), F.lit(")Zz(1)Qq(2)"))
    return t("part").select("p_partkey", sc.formula_counts(formula).alias("m")).select("p_partkey", F.col("m")["C"].alias("c"), F.col("m")["H"].alias("h"), F.col("m")["?"].alias("unknown"))


@query("c17_instrument_index", "SELECT p_partkey, CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 1 WHEN 'widget' THEN 2 ELSE 0 END AS idx FROM part")
def _(spark, t):
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    return t("part").select("p_partkey", sc.instrument_index(second, {"Ring": "one", "Widget": "two"}, ["other", "one", "two"], "other").alias("idx"))


@query("c18_log2p1", "SELECT p_partkey, round(log2(p_size + 1), 6) AS x, round(pow(2, log2(p_size + 1)) - 1, 6) AS back FROM part")
def _(spark, t):
    x = sc.log2p1("p_size")
    return t("part").select("p_partkey", F.round(x, 6).alias("x"), F.round(sc.inv_log2p1(x), 6).alias("back"))


@query("c19_normalize_rt", "SELECT p_partkey, round((p_retailprice - 900) / (1000 - 900), 6) AS x, round(p_retailprice, 4) AS back FROM part")
def _(spark, t):
    x = sc.normalize_rt("p_retailprice", 900, 1000)
    return t("part").select("p_partkey", F.round(x, 6).alias("x"), F.round(sc.denormalize_rt(x, 900, 1000), 4).alias("back"))


_RED = "((p_size % 3 + 1) * p_retailprice * 28.0 / ((p_size % 3 + 1) * p_retailprice + 28.0))"


@query("c20_mobility_ccs", f"SELECT p_partkey, round((p_size / 50.0) * (p_size % 3 + 1) * 1059.62245 / sqrt({_RED}), 4) AS ccs, round(p_size / 50.0, 6) AS back FROM part")
def _(spark, t):
    z, m = F.col("p_size") % 3 + 1, F.col("p_retailprice")
    ccs = sc.mobility_to_ccs(F.col("p_size") / 50, z, m)
    return t("part").select("p_partkey", F.round(ccs, 4).alias("ccs"), F.round(sc.ccs_to_mobility(ccs, z, m), 6).alias("back"))


@query("c21_fill_text", "SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, '') AS mods, coalesce(length(CASE WHEN quality = 1 THEN 'good' END), 0) AS n FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, t):
    rows = t("documents").select("doc_id").join(t("labels"), "doc_id", "left").withColumn("mods", sc.fill_text(F.when(F.col("quality") == 1, "good")))
    return rows.select("doc_id", "mods", F.length("mods").alias("n"))


@query("c22_clip_floor", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_discount - 0.05, 0.0) AS v FROM lineitem")
def _(spark, t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sc.clip_floor(F.col("l_discount") - 0.05, 0.0).alias("v"))


@query("t01_digest", f"SELECT doc_id, pep AS peptide FROM ({tb.PEPTIDES_SQL})")
def _(spark, t):
    return tb.peptides(t).select("doc_id", "peptide")


_MISSED = f"""WITH x AS (SELECT doc_id, list_filter(string_split(replace(regexp_replace(seq, '([KR])', '\\1|', 'g'), '|P', 'P'), '|'), lambda p: p <> '') AS x FROM ({tb.PROTEINS_SQL})),
i AS (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM x) SELECT DISTINCT doc_id, array_to_string(x[i:i+n], '') AS peptide FROM i, (VALUES (0), (1)) t(n) WHERE i + n <= len(x)"""


@query("t01_digest_missed", f"SELECT doc_id, count(*) AS n, sum(length(peptide))::BIGINT AS chars FROM ({_MISSED}) WHERE length(peptide) BETWEEN 7 AND 35 GROUP BY doc_id")
def _(spark, t):
    cut = gen.digest(tb.proteins(t), ["doc_id"], "seq", "Trypsin", 1, 7, 35)
    return cut.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("peptide")).alias("chars"))


def _enzyme_sql(index: int) -> str:
    """Peptides of 7 to 12 residues by one of the cutting rules, with marks at the cuts."""
    name, before, after, forbid = gen.ENZYMES[index]
    if index == 0:
        cut = "SELECT DISTINCT doc_id, seq[i : i + n - 1] AS p FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 5)) AS i FROM s) JOIN (VALUES (7), (8)) t(n) ON i + n - 1 <= length(seq)"
    else:
        marked = f"regexp_replace(seq, '([{before}])', '\\1|', 'g')" if before else f"regexp_replace(seq, '([{after}])', '|\\1', 'g')"
        marked = f"replace({marked}, '|{forbid}', '{forbid}')" if forbid else marked
        cut = f"SELECT DISTINCT doc_id, unnest(string_split({marked}, '|')) AS p FROM s"
    return f"SELECT '{name}' AS enzyme, doc_id, count(*) AS n, sum(length(p))::BIGINT AS residues FROM ({cut}) WHERE length(p) BETWEEN 7 AND 12 GROUP BY doc_id"


@query("t02_enzymes", f"WITH s AS ({tb.PROTEINS_SQL}) " + " UNION ALL ".join(_enzyme_sql(k) for k in range(1, len(gen.ENZYMES))))
def _(spark, t):
    """Every rule but the non-specific one."""
    return gen.digest_totals(tb.proteins(t), ["doc_id"], "seq", [name for name, *_ in gen.ENZYMES[1:]], 7, 12)


@query("t02_non_specific", f"WITH s AS (SELECT item_id AS doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark) {_enzyme_sql(0)}")
def _(spark, t):
    items = t("benchmark").select(F.col("item_id").alias("doc_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))
    cut = gen.digest(items, ["doc_id"], "seq", "non-specific", 0, 7, 8).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("peptide")).alias("residues"))
    return cut.select(F.lit("non-specific").alias("enzyme"), "doc_id", "n", "residues")


@query("t02_other_enzymes", f"""SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split(regexp_replace(seq, '([DE])', '|\\1', 'g'), '|')) AS p FROM ({tb.PROTEINS_SQL})) WHERE length(p) BETWEEN 7 AND 12 GROUP BY doc_id""")
def _(spark, t):
    return gen.digest(tb.proteins(t), ["doc_id"], "seq", "Asp-N (ambic)", 0, 7, 12).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("t03_expand_charges", f"SELECT doc_id, pep || '|' || z AS form FROM ({tb.PEPTIDES_SQL}), (VALUES (2), (3)) t(z)")
def _(spark, t):
    return gen.expand_charges(tb.peptides(t), "peptide", 2, 3).select("doc_id", "form")


def _isoforms_sql(most: int) -> str:
    """Isoforms by joins of sites: up to ``most`` of Oxidation on M, Phospho on S and Methyl on S; Carbamidomethyl on every C."""
    sets = ["SELECT pep, []::STRUCT(site INT, name VARCHAR)[] AS m, 0 AS upto FROM p"]
    sets += [f"SELECT v.pep, v.m || [struct_pack(site := s.site, name := s.name)] AS m, s.site AS upto FROM v{j} v JOIN s ON s.pep = v.pep AND s.site > v.upto" for j in range(most)]
    steps = ", ".join(f"v{j} AS ({q})" for j, q in enumerate(sets))
    every = " UNION ALL ".join(f"SELECT pep, m FROM v{j}" for j in range(most + 1))
    return f"""WITH p AS (SELECT DISTINCT pep FROM ({tb.PEPTIDES_SQL})), r AS (SELECT pep, unnest(range(1, length(pep) + 1))::INT AS site FROM p),
s AS (SELECT pep, site, n.name FROM r JOIN (VALUES ('M', 'Oxidation'), ('S', 'Phospho'), ('S', 'Methyl')) n(c, name) ON pep[site] = n.c),
f AS (SELECT pep, list(struct_pack(site := site, name := 'Carbamidomethyl')) AS m FROM r WHERE pep[site] = 'C' GROUP BY pep), {steps}, e AS ({every})
SELECT e.pep AS peptide, array_to_string(list_transform(list_sort(e.m || coalesce(f.m, [])), lambda x: x.site || ':' || x.name), ';') AS mods FROM e LEFT JOIN f ON f.pep = e.pep"""


for _most in (2, 4):

    @query(f"t04_expand_isoforms{'' if _most == 2 else f'_{_most}'}", _isoforms_sql(_most))
    def _(spark, t, most=_most):
        rules = [("Oxidation", "M"), ("Phospho", "S"), ("Methyl", "S")]
        forms = gen.expand_isoforms(tb.peptides(t).groupBy("peptide").agg(F.bool_or("n_term").alias("n_term")), "peptide", "n_term", rules, [("Carbamidomethyl", "C")], most)
        return forms.select("peptide", F.array_join(F.transform("mods", lambda m: F.concat(m["site"].cast("string"), F.lit(":"), m["name"])), ";").alias("mods"))


@query("t05_candidate_sites", f"SELECT DISTINCT pep AS peptide, array_to_string(list_filter(range(1, length(pep) + 1), lambda i: pep[i] = 'S'), ',') AS sites FROM ({tb.PEPTIDES_SQL})")
def _(spark, t):
    return tb.peptides(t).select("peptide", F.array_join(gen.candidate_sites(F.col("peptide"), F.col("n_term"), "S").cast("array<string>"), ",").alias("sites")).distinct()


_MASSES = ", ".join(f"('{k}', {v})" for k, v in RESIDUE_MASS.items())
_FRAGMENTS = f"""WITH p AS (SELECT DISTINCT pep FROM ({tb.PEPTIDES_SQL})), r AS (SELECT pep, i, coalesce(m, 0) AS m FROM (SELECT pep, unnest(range(1, length(pep) + 1)) AS i FROM p) LEFT JOIN (VALUES {_MASSES}) t(c, m) ON c = pep[i]),
s AS (SELECT pep, i, sum(m) OVER (PARTITION BY pep ORDER BY i) AS b, sum(m) OVER (PARTITION BY pep ORDER BY i DESC) AS y, length(pep) AS n FROM r),
f AS (SELECT pep, 'b' AS ion, i AS number, b AS mass FROM s WHERE i < n UNION ALL SELECT pep, 'y', n - i + 1, y + 18.0105646863 FROM s WHERE i > 1)"""


@query("t06_fragments", _FRAGMENTS + f" SELECT pep AS peptide, ion, count(*) AS n, round(sum((mass - l) / z + {PROTON}), 3) AS total FROM f, (VALUES (1), (2)) a(z), (VALUES (0), (18.0105646863)) c(l) GROUP BY ALL")
def _(spark, t):
    ions = gen.fragments(tb.peptides(t).select("peptide", F.lit(3).alias("charge")).distinct(), "peptide", "charge", ("H2O",))
    return ions.groupBy("peptide", "ion").agg(F.count("*").alias("n"), F.round(F.sum("frag_mz"), 3).alias("total"))


@query("t07_explode_peaks", f"SELECT user_id, day AS mz, v AS intensity FROM ({tb.DAILY_SQL})")
def _(spark, t):
    return gen.explode_peaks(tb.series(t).withColumn("days", F.transform("values", lambda x, i: i)), "days", "values")


@query("t08_melt_fragments", """SELECT l_orderkey, l_partkey, 'b' AS ion, 1 AS frag_charge, '' AS loss, l_quantity AS intensity FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'y', 2, '', l_tax FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'y', 1, 'modloss', l_discount FROM lineitem""")
def _(spark, t):
    wide = t("lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("b_z1"), F.col("l_tax").alias("y_z2"), F.col("l_discount").alias("y_modloss_z1"))
    return gen.melt_fragments(wide, ["l_orderkey", "l_partkey"], ["b_z1", "y_z2", "y_modloss_z1"])


_REG = """WITH s AS (SELECT p_name || ' of ' || p_type AS name, p_type AS site, (p_retailprice - 900) * 3 AS mass, p_brand AS acc FROM part WHERE abs((p_retailprice - 900) * 3) <= 250 AND p_size <> 50),
k AS (SELECT *, coalesce(mass - lag(mass) OVER (PARTITION BY acc, site ORDER BY mass, name) <= 0.001 AND upper(name) NOT LIKE '%TMT%', false) AS same FROM s),
g AS (SELECT name AS mod_name, site, mass, row_number() OVER (ORDER BY acc, site, mass, name) AS mod_id FROM k WHERE NOT same)"""


def _registry(t):
    raw = t("part").select(F.concat("p_name", F.lit(" of "), "p_type").alias("mod_name"), ((F.col("p_retailprice") - 900) * 3).alias("mass"), F.when(F.col("p_size") == 50, "substitution").otherwise("chemical").alias("kind"), F.col("p_brand").alias("accession"))
    return rg.build_registry(raw, "mod_name", "mass", "kind", "accession")


@query("d01_build_registry", _REG + " SELECT mod_id, mod_name, site, round(mass, 6) AS mass FROM g")
def _(spark, t):
    return _registry(t).select("mod_id", "mod_name", "site", F.round("mass", 6).alias("mass"))


@query("d02_add_user_mods", _REG + " SELECT mod_id, mod_name, site, round(mass, 6) AS mass FROM g UNION ALL SELECT max(mod_id) + 1, 'Alpha', 'K', 12.5 FROM g UNION ALL SELECT max(mod_id) + 2, 'Beta', 'M', -3.25 FROM g")
def _(spark, t):
    return rg.add_user_mods(_registry(t), "Beta,M,-3.25;Alpha,K,12.5,C(1)").withColumn("mass", F.round("mass", 6))


@query("d03_override_mass", _REG + " SELECT mod_id, round(CASE mod_id WHEN 1 THEN 1.5 WHEN 3 THEN 2.5 ELSE mass END, 6) AS mass FROM g")
def _(spark, t):
    return rg.override_mass(_registry(t), "1@1.5,3@2.5").select("mod_id", F.round("mass", 6).alias("mass"))


@query("d04_list_registry", _REG + " SELECT mod_id, mod_name FROM g ORDER BY mod_id LIMIT 10")
def _(spark, t):
    return rg.list_registry(_registry(t), 10).select("mod_id", "mod_name")


_SCORE = "SELECT vec_id, round(list_avg(embedding::DOUBLE[]) * 3 + 1, 5) AS score FROM embeddings"


@query("x01_score_batches", _SCORE)
def _(spark, t):
    rows = t("embeddings").withColumn("length", F.size("embedding"))

    def score(frame):
        import numpy as np

        return np.stack(frame["embedding"].to_numpy()).astype("f8").mean(1) * 3 + 1

    return scoring.score_batches(rows, score, "score", "length").select("vec_id", F.round("score", 5).alias("score"))


@query("x01_score_arrays", """SELECT vec_id, round(list_avg(x), 5) AS mean, len(x[1 : vec_id % 5])::INT AS n_head, round(coalesce(list_sum(x[1 : vec_id % 5]), 0) * 2, 4) AS head, len(list_filter(x, lambda v: v > 0))::BIGINT AS n_positive
FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)""")
def _(spark, t):
    rows = t("embeddings").select("vec_id", "embedding", F.size("embedding").alias("length"))

    def load():
        import numpy as np

        def score(frame):
            x = np.stack(frame["embedding"].to_numpy()).astype("f8")
            return {"mean": x.mean(1), "head": [v[: i % 5] * 2 for i, v in zip(frame["vec_id"], x, strict=True)], "n_positive": (x > 0).sum(1)}

        return score

    told = scoring.score_batches(rows, None, {"mean": "double", "head": "array<double>", "n_positive": "bigint"}, "length", factory=load)
    total = F.aggregate("head", F.lit(0.0), lambda a, v: a + v)
    return told.select("vec_id", F.round("mean", 5).alias("mean"), F.size("head").alias("n_head"), F.round(total, 4).alias("head"), "n_positive")


@query("x01_linear_score", _SCORE)
def _(spark, t):
    return scoring.linear_score(t("embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding", 3.0, 1.0).select("vec_id", F.round("score", 5).alias("score"))
