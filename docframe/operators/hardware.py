"""Hardware attributes: one vocabulary for catalogues and requirements, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions import values
from docframe.functions.compat import blank_to_null, dealt, strip

#: Units of the common attributes; those without a unit are counts or words.
ATTR_UNITS = {
    "tdp_w": "W", "form_factor": None, "interface": None,
    "cores": None, "threads": None, "base_clock_ghz": "GHz", "boost_clock_ghz": "GHz", "socket": None, "memory_channels": None, "max_memory_gb": "GB", "ecc": None,
    "memory_size_gb": "GB", "memory_type": None, "memory_bus_bits": "bit", "memory_bandwidth_gbs": "GB/s", "shaders": None, "tensor_cores": None, "rt_cores": None, "fp32_gflops": "GFLOPS", "fp16_gflops": "GFLOPS", "fp64_gflops": "GFLOPS",
    "capacity_gb": "GB", "speed_mts": "MT/s", "rpm": "RPM", "watts": "W", "efficiency": None, "speed_gbps": "Gbps", "ports": None, "size_inch": "inch", "resolution": None,
}
#: Catalogue columns and their common attributes.
CPU_ATTRS = {"cores": "cores", "threads": "threads", "base_clock_ghz": "base_clock_ghz", "boost_clock_ghz": "boost_clock_ghz", "tdp_w": "tdp_w", "socket": "socket", "memory_channels": "memory_channels", "max_memory_gb": "max_memory_gb", "memory_types": "memory_type", "ecc_support": "ecc"}
GPU_ATTRS = {"memory_size": "memory_size_gb", "memory_type": "memory_type", "memory_bus": "memory_bus_bits", "memory_bandwidth": "memory_bandwidth_gbs", "shaders": "shaders", "tensor_cores": "tensor_cores", "rt_cores": "rt_cores", "fp32": "fp32_gflops", "fp16": "fp16_gflops", "fp64": "fp64_gflops", "tdp": "tdp_w"}
#: Attributes that a category may have.
CATEGORY_ATTRS = {
    "CPU": ("cores", "threads", "base_clock_ghz", "boost_clock_ghz", "tdp_w", "socket", "memory_channels", "max_memory_gb", "memory_type", "ecc"),
    "GPU": ("memory_size_gb", "memory_type", "memory_bus_bits", "memory_bandwidth_gbs", "shaders", "tensor_cores", "rt_cores", "fp32_gflops", "fp16_gflops", "fp64_gflops", "tdp_w", "interface"),
    "RAM": ("capacity_gb", "memory_type", "speed_mts", "ecc", "form_factor"),
    "SSD": ("capacity_gb", "interface", "form_factor"),
    "HDD": ("capacity_gb", "interface", "form_factor", "rpm"),
    "메인보드": ("socket", "memory_channels", "form_factor", "ports"),
    "파워": ("watts", "efficiency"),
    "케이스": ("form_factor",),
    "쿨러": ("tdp_w", "form_factor"),
    "네트워크": ("speed_gbps", "ports", "interface"),
    "모니터": ("size_inch", "resolution"),
    "완제품": ("form_factor", "watts", "tdp_w"),
    "기타": (),
}
#: Words for false.
FLAG_FALSE = ("no", "false", "미지원", "없음", "비지원", "non-ecc", "nonecc")


def canonical_attributes(catalogue: DataFrame, key: str, mapping: dict[str, str], flags: tuple[str, ...] = ("ecc_support",)) -> DataFrame:
    """(key, attr, value, unit) of each attribute that isn't null, all values as text; a flag is true for Yes, else false.

    One narrow pass: the columns become an array that is unfolded, no join or shuffle.
    """

    def cell(column: str, attr: str) -> Column:
        c = F.col(column)
        value = F.when(c.isNotNull(), (c == "Yes").cast("string")) if column in flags else c.cast("string")
        return F.struct(F.lit(attr).alias("attr"), value.alias("value"), F.lit(ATTR_UNITS.get(attr)).cast("string").alias("unit"))

    have = [cell(c, a) for c, a in mapping.items() if c in catalogue.columns]
    return catalogue.select(key, F.inline(F.array(*have))).where("value is not null")


def canonical_values(catalogue: DataFrame, key: str, mapping: dict[str, str], flags: tuple[str, ...] = ("ecc_support",), keep: tuple[str, ...] = ()) -> DataFrame:
    """As canonical_attributes, with each value a VARIANT of its column's kind: a number, a text, or a flag (true for Yes). keep: columns that come along."""

    def cell(column: str, attr: str) -> Column:
        c, kind = F.col(column), catalogue.schema[column].dataType
        if column in flags:
            value = F.when(c.isNotNull(), c == "Yes").cast("variant")
        elif isinstance(kind, T.NumericType):
            value = c.cast("double").cast("variant")
        else:
            value = c.cast("variant") if isinstance(kind, (T.StringType, T.BooleanType)) else values.of(c)
        return F.struct(F.lit(attr).alias("attr"), value.alias("value"), F.lit(ATTR_UNITS.get(attr)).cast("string").alias("unit"))

    have = [cell(c, a) for c, a in mapping.items() if c in catalogue.columns]
    return catalogue.select(key, *keep, F.inline(F.array(*have))).where("value is not null")


def flag_value(attr: Column, value: Column, flags: tuple[str, ...] = ("ecc",)) -> Column:
    """A flag's text as true or false; blank text and other attributes stay."""
    word = F.lower(strip(value))
    return F.when(~attr.isin(*flags) | (word == ""), value).when(word.isin(*FLAG_FALSE), "false").otherwise(F.when(value.isNotNull(), "true"))


def flag_variant(attr: Column, value: Column, flags: tuple[str, ...] = ("ecc",)) -> Column:
    """As flag_value, of a VARIANT: a flag's text becomes true or false, other values stay what they are (numbers as doubles)."""
    said = flag_value(attr, values.text(value), flags)
    return F.when(attr.isin(*flags) & said.isin("true", "false"), (said == "true").cast("variant")).otherwise(values.value(value))


def reconcile_name(name: Column, named: Column) -> tuple[Column, Column]:
    """A blank name is null, and then the part isn't named."""
    kept = blank_to_null(name)
    return F.when(kept.isNotNull(), name), F.when(kept.isNull(), F.lit(False)).otherwise(named)


def sufficient(columns: list[str]) -> Column:
    """Whether any of the columns holds something."""
    return F.exists(F.array(*[F.col(c).isNotNull() for c in columns]), lambda x: x)


def extractions(rows: DataFrame, cpu: str = "cpu", gpu: str = "gpu", ignored: tuple[str, ...] = ("name", "quotes")) -> tuple[DataFrame, DataFrame]:
    """(rows with is_sufficient_data, rows without a product): structs cpu and gpu, of which one at least must be there; sufficient if a field but the ignored ones is."""
    filled = [F.col(f"{c}.{f.name}") for c in (cpu, gpu) for f in rows.schema[c].dataType if f.name not in ignored]
    neither = F.col(cpu).isNull() & F.col(gpu).isNull()
    return rows.where(~neither).withColumn("is_sufficient_data", F.exists(F.array(*[c.isNotNull() for c in filled]), lambda x: x)), rows.where(neither)


def stray_attributes(constraints: DataFrame) -> DataFrame:
    """constraints (category, attr) whose attribute isn't one of the category's."""
    allowed = F.create_map(*[x for c, attrs in CATEGORY_ATTRS.items() for x in (F.lit(c), F.array(*map(F.lit, attrs)).cast("array<string>"))])
    return constraints.where(~F.coalesce(F.array_contains(F.element_at(allowed, F.col("category")), F.col("attr")), F.lit(False)))


def match_requirements(attributes: DataFrame, constraints: DataFrame, key: str) -> DataFrame:
    """(requirement, key, n_ok, n_constraints, verdict) of each product that has one of a requirement's attributes.

    attributes: key, attr, value. constraints: requirement, attr, op (gte, lte,
    eq, approx), value. pass if all hold, fail if one fails, needs_review if
    none fails but one is approx or its attribute isn't known. The join is on
    the attribute. Where the constraints are few enough to be broadcast,
    attributes are dealt by product to tasks of bounded size, and no other
    shuffle follows.
    """
    few = constraints.limit(100_001).count() <= 100_000
    n = constraints.groupBy("requirement").agg(F.count("*").alias("n_constraints"))
    asked = constraints.select("requirement", "attr", "op", F.col("value").alias("wanted"))
    have, want = F.col("value").try_cast("double"), F.col("wanted").try_cast("double")
    ok = (
        F.when(F.col("op") == "approx", None).when(F.col("op") == "gte", have >= want).when(F.col("op") == "lte", have <= want)
        .otherwise(F.when(have.isNotNull() & want.isNotNull(), have == want).otherwise(F.lower(strip(F.col("value"))) == F.lower(strip(F.col("wanted")))))
    )
    met = (dealt(attributes, key).join(F.broadcast(asked), "attr") if few else attributes.join(asked, "attr")).withColumn("ok", ok).groupBy("requirement", key).agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_bad"))
    verdict = F.when(F.col("n_bad") > 0, "fail").when(F.col("n_ok") == F.col("n_constraints"), "pass").otherwise("needs_review")
    return met.join(F.broadcast(n) if few else n, "requirement").select("requirement", key, "n_ok", "n_constraints", verdict.alias("verdict"))
