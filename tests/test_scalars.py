from pyspark.sql import functions as F

from peaklane.functions import scalars as sc


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def mods(*pairs):
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("site")) for n, s in pairs])


def test_unimod_markers(spark):
    assert one(spark, sc.parse_unimod(F.lit("SSSFSC(unimod:4)PE(unimod:35)"))) == {6: "C(unimod:4)", 8: "E(unimod:35)"}
    assert one(spark, sc.parse_unimod(F.lit("(UniMod:41)SSSFSCPC(UniMod:4)"))) == {0: "UniMod:41", 8: "C(UniMod:4)"}
    assert one(spark, sc.strip_unimod(F.lit("(unimod:41)SSSFSCPC(unimod:4)"))) == "SSSFSCPC"
    assert one(spark, sc.parse_unimod(F.lit(""))) == {}


def test_codes(spark):
    codes = {"acetyl": "5", "oxidation": "1"}
    assert one(spark, sc.encode_modified(F.lit("ADPEVCCFITK"), mods(("acetyl", 0), ("carbamidomethyl", 6), ("carbamidomethyl", 7)), codes)) == "5ADPEVCCFITK-"
    assert one(spark, sc.encode_modified(F.lit("MAME"), mods(("oxidation", 1), ("oxidation", 3)), codes)) == "-1A1E-"
    assert one(spark, sc.encode_modified(F.lit("MADAEKNAVAEK"), mods(("acetyl", 0), ("oxidation", 1)), codes)) == "51ADAEKNAVAEK-"


def test_bracketed_masses(spark):
    names = {"acetyl": "42.0105646837", "oxidation": "15.99491461956"}
    assert one(spark, sc.render_modified(F.lit("AANSGLDSK"), mods(("acetyl", 0)), names, "mass")) == "A[42.0105646837]ANSGLDSK"
    assert one(spark, sc.render_modified(F.lit("MAAAAAAAAAGAAGGR"), mods(("acetyl", 0), ("oxidation", 1)), names, "mass")) == "M[58.00547930326]AAAAAAAAAGAAGGR"
    assert one(spark, sc.render_modified(F.lit("AMK"), mods(("o", 2)), {"o": "Oxidation (M)"}, "name")) == "AM[Oxidation (M)]K"


def test_small_ones(spark):
    assert one(spark, sc.half_up(F.lit(-2.5))) == -2
    assert one(spark, sc.reverse_inner(F.lit("ABCDE"))) == "ADCBE"
    assert one(spark, sc.formula_counts(F.lit("H(2)C(1)Zz(3)Qq(1)"))) == {"H": 2, "C": 1, "?": 4}
    assert list(one(spark, sc.parse_title(F.lit("a:b:12:3")))) == ["a:b", 12, 3]
    assert one(spark, sc.primary_accession(F.lit("P1;P2"))) == "P1"
    assert one(spark, sc.residue_codes(F.lit("AZ"))) == [0, 1, 26, 0]
