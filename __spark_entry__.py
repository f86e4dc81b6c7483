"""

Every query derives a food web from the given tables (see
``trophos/sources/derived.py``) and runs one operator on all of it.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trophos.functions.quantiles import PROBS, STATS, quantile_summary, quantiles_long
from trophos.functions.sketches import merge_states, sketch_state, state_quantiles
from trophos.operators import charts, metadata, mortality, network, ratios, series
from trophos.plans.analyze import analyze, compute
from trophos.plans.scratch import Scratch
from trophos.schemas import REGISTRY, VARIABLES, quant_columns
from trophos.sources import store, trajectories
from trophos.sources.derived import Sales
from trophos.sources.model import dimension, local_table, read_model, validate_model, value_columns
from trophos.sources.metadata import read_metadata, write_metadata

try:
    import corpus_pipeline
    from trophos.llm import queries as training
except ImportError as missing:
    if missing.name not in ("corpus_pipeline", "trophos.llm", "trophos.llm.queries"):
        raise
    corpus_pipeline = training = None

SMALL = "/root/testdata/sf0.001"
LABEL = "All"
LINES = [2, 3, 5]


def entry(spark: SparkSession) -> DataFrame:
    return queries()["biomass_series"](spark, SMALL)


# --- inputs ---------------------------------------------------------------


def _info(sales: Sales) -> DataFrame:
    """Labels of all components, from the customers alone."""
    names = [(c,) for c in sales.regions() + sales.fleets()]
    components = local_table(sales.spark, names, "Component string")
    clean = metadata.validate_metadata(sales.raw_info())
    return dimension(metadata.reconcile_metadata(clean, components))


def _wide(sales: Sales):
    """The web as a stored wide matrix of four chains, and its fluxes."""
    scratch = Scratch(sales.spark)
    long = scratch.keep(sales.long(), "long")
    fluxes = dimension(_fluxes_of(long))
    ids = fluxes.select("Flux", F.concat("From", F.lit("_"), "To").alias("Var"))
    cells = long.join(ids, "Var", "left").select(
        ((F.col("Sample_id") - 1) % 4 + 1).cast("int").alias("chain"),
        (F.floor((F.col("Sample_id") - 1) / 4) + 1).cast("long").alias("iter"),
        F.concat(F.coalesce("Flux", "Var"), F.lit("["), F.col("Year").cast("string"), F.lit("]")).alias("name"),
        "value",
    )
    names = sorted(r["name"] for r in cells.select("name").distinct().collect())
    matrix = cells.groupBy("chain", "iter").pivot("name", names).agg(F.first("value"))
    scratch.keep(matrix, "wide")
    return trajectories.read_trajectories(sales.spark, f"{scratch.path}/wide"), fluxes


def _fluxes_of(long: DataFrame) -> DataFrame:
    edges = long.filter(F.col("kind") == "flux").select("src", "dst").distinct()
    number = F.expr("cast(row_number() over (order by concat(src, '_', dst)) as string)")
    return edges.select(
        F.concat(F.lit("X"), number).alias("Flux"), F.col("src").alias("From"), F.col("dst").alias("To")
    )


def _model(sales: Sales):
    fluxes = dimension(sales.fluxes())
    return sales.components(fluxes), fluxes


def _resolution(sales: Sales) -> DataFrame:
    components, fluxes = _model(sales)
    return network.component_resolution(components, fluxes, sales.long())


def _rounded(quant: DataFrame) -> DataFrame:
    return quant.withColumn("Value", F.round("Value", 9))


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


# --- queries --------------------------------------------------------------


def wide_scan(sales):
    wide, _ = _wide(sales)
    cells = F.expr("array(" + ", ".join(f"`{c}`" for c in value_columns(wide)) + ")")
    filled = F.filter(cells, lambda v: v.isNotNull())
    total = F.aggregate(filled, F.lit(0.0), lambda s, v: s + v)
    return wide.select(
        "chain", "iter", "Sample_id", F.size(filled).cast("long").alias("cells"), F.round(total, 6).alias("total")
    )


def to_long(sales):
    wide, fluxes = _wide(sales)
    return trajectories.to_long(wide, fluxes).drop("Trophic")


def model_tables(sales):
    """The derived tables written as CSV files and read as a model's."""
    path = f"{Scratch(sales.spark).path}/model"
    fluxes = sales.fluxes()
    sales.components(fluxes).write.csv(f"{path}/components", header=True, nullValue="NA")
    fluxes.write.csv(f"{path}/fluxes", header=True, nullValue="NA")
    components, fluxes = read_model(sales.spark, path, "csv")
    nodes = components.select(
        F.lit("component").alias("kind"), F.col("Component").alias("name"),
        F.lit(None).cast("string").alias("From"), F.lit(None).cast("string").alias("To"),
        "Inside", "X", "Y",
    )
    edges = fluxes.select(F.lit("flux").alias("kind"), F.col("Flux").alias("name"), "From", "To")
    return nodes.unionByName(edges, allowMissingColumns=True)


def validate(sales):
    """The checks of a good model, and of one with a component listed twice
    and without its fluxes' targets."""
    wide, fluxes = _wide(sales)
    components = sales.components(fluxes)
    good = {
        "mcmc": wide, "components_param": components, "species": None, "fluxes_def": fluxes, "ntstep": None,
    }
    bad = {**good, "components_param": components.union(components), "fluxes_def": fluxes.drop("To")}
    parts = [
        validate_model(tables).select(F.lit(name).alias("model"), "check", "ok", "message")
        for name, tables in (("good", good), ("bad", bad))
    ]
    return parts[0].unionByName(parts[1])


def metadata_clean(sales):
    return metadata.validate_metadata(sales.raw_info())


def metadata_reconcile(sales):
    components, _ = _model(sales)
    return metadata.reconcile_metadata(metadata_clean(sales), components)


def resolved_components(sales):
    resolution = dimension(_resolution(sales))
    parts = [
        network.resolved_components(resolution, v).select(F.lit(v).alias("Variable"), "Component")
        for v in network.ELIGIBLE
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def select_valid(sales):
    resolved = network.resolved_components(dimension(_resolution(sales)), "Ratio Consumption/Biomass")
    selected = metadata_clean(sales).select(F.col("ID").alias("Component"))
    return network.select_valid(selected, resolved)


def series_run(variable, group=False):
    needs_biomass = variable.startswith(("Ratio", "Mortality"))
    needs_info = variable in ("Consumption", "Predation and Fisheries")

    def run(sales):
        names = sales.regions() if needs_biomass else None
        info = _info(sales) if needs_info else None
        label = LABEL if group else None
        return _rounded(compute(variable, sales.long(), names, info, group, label, names=names))

    return run


def _analyze(sales, group=False):
    """All seven variables for a selection of every name there is, known to the
    model or not: what a variable cannot use is left out."""
    components, fluxes = _model(sales)
    # all seven read the table that is derived once
    long, info = Scratch(sales.spark).keep(sales.long(), "long"), _info(sales)
    resolution = dimension(network.component_resolution(components, fluxes, long))
    names = [r["ID"] for r in info.collect()] + ["Z0"]
    edges = [r["Flux"] for r in fluxes.collect()]
    out = None
    for variable in VARIABLES:
        selected = edges if variable == "Fluxes" else names
        quant = _rounded(analyze(variable, long, selected, info, resolution, fluxes, group, LABEL))
        out = quant if out is None else out.unionByName(quant, allowMissingColumns=True)
    return out.select("Year", "Var", "Unit", "ID", "Prey", "Predator", "Metric", "Stat", "Value")


def _named(summary, *keys):
    names = [s.replace(".", "_") for s in STATS]
    return summary.select(*keys, *[F.round(f"`{s}`", 9).alias(n) for s, n in zip(STATS, names)])


def summary(sales):
    values = series.biomass_values(sales.long(), None)
    return _named(quantile_summary(values, ["Year", "ID"]), "Year", "ID")


def selection(sales):
    """All values of a kind and year pooled: the largest groups there are."""
    q = quantile_summary(sales.long(), ["Year", "kind"], method="bins")
    return _named(q, "Year", "kind")


def sketched(sales):
    """Sketches of each of eight parts of the samples, merged: whether every
    quantile's rank among the pooled values is within 2 % of where it should be."""
    rows = sales.long().select("Year", "kind", "Sample_id", "value")
    keys = ["Year", "kind"]
    parts = sketch_state(rows.withColumn("part", F.col("Sample_id") % 8), [*keys, "part"])
    found = state_quantiles(merge_states(parts, keys), keys, PROBS)
    found = found.select(*keys, F.posexplode("q").alias("i", "q"))
    probs, names = F.array(*map(F.lit, PROBS)), F.array(*map(F.lit, STATS))
    r, f = rows.alias("r"), found.alias("f")
    pairs = r.join(f, (F.col("r.Year") == F.col("f.Year")) & (F.col("r.kind") == F.col("f.kind")))
    ranks = pairs.groupBy("f.Year", "f.kind", "i").agg(
        F.count("*").alias("n"),
        F.avg((F.col("value") < F.col("q")).cast("double")).alias("below"),
        F.avg((F.col("value") <= F.col("q")).cast("double")).alias("upto"),
    )
    p = F.get(probs, F.col("i"))
    close = (F.col("below") <= p + 0.02) & (F.col("upto") >= p - 0.02)
    return ranks.select("Year", "kind", F.get(names, F.col("i")).alias("Stat"), F.col("n").alias("n_values"), close.alias("is_close"))


def summary_long(sales):
    values = sales.flux().select("Year", F.col("src").alias("ID"), "value")
    q = quantile_summary(values, ["Year", "ID"])
    return _rounded(quantiles_long(q, ["Year", "ID"], "Fluxes by prey", "1000t"))


def trajectory_sample(sales):
    values = ratios.ratio_samples(sales.long(), sales.regions(), "dst")
    return _round(charts.trajectory_sample(values, LINES), "S1", "S2", "S3")


def random_lines(sales):
    """Lines of three samples drawn once, for all biomasses and all fluxes."""
    long = sales.long()
    drawn = charts.draw_samples(long, 3, seed=7)
    few = charts.only_samples(long, drawn)
    parts = [
        charts.sampled_lines(values, drawn, 3).select(F.lit(name).alias("Var"), "Year", "ID", "S1", "S2", "S3")
        for name, values in (("Biomass", series.biomass_values(few, None)), ("Fluxes", series.flux_values(few)))
    ]
    return parts[0].unionByName(parts[1])


def _proportions(values, keys, chart_keys=()):
    means = charts.mean_by_target(values, keys)
    # A mean of 5-decimal values over 32 or more samples may end in a tie at 9
    # decimals; at 3 decimals that is rare.
    shares = charts.proportion_by_year(means, chart_keys)
    return shares.withColumns({"value": F.round("value", 3), "proportion": F.round("proportion", 9)})


def proportion_by_year(sales):
    flows = series.predation_values(sales.long(), None, _info(sales))
    return _proportions(flows, ["Year", "ID", "target", "Colour_target"], ["ID"])


def proportion_consumption(sales):
    flows = series.consumption_values(sales.long(), None, _info(sales))
    return _proportions(flows, ["Year", "ID", "target", "Colour_target"], ["ID"])


def proportion_biomass(sales):
    """Shares of the members of a group of all components."""
    return _proportions(series.biomass_values(sales.long(), sales.regions()), ["Year", "ID"])


def proportion_flux(sales):
    """Shares of the members of a group of all edges."""
    return _proportions(series.flux_values(sales.long()), ["Year", "ID"])


def _beta(share):
    def run(sales):
        rates = mortality.mortality_values(sales.long(), sales.regions())
        return _round(charts.beta_params(rates, share=share), "mean", "var", "a", "b")

    return run


def _bands(share):
    def run(sales):
        rates = mortality.mortality_values(sales.long(), sales.regions())
        bands = charts.beta_bands(charts.beta_params(rates, share=share))
        # the two sides sum series of different forms: 6 decimals are common to both
        return bands.withColumns({c: F.round(c, 6) for c in ("bottom", "top", "mean_F", "q05", "q95")})

    return run


def flux_colours(sales):
    labels = network.flux_labels(sales.fluxes(), _info(sales))
    return network.assign_colours(labels)


def foodweb_nodes(sales):
    components, fluxes = _model(sales)
    info = metadata.reconcile_metadata(metadata_clean(sales), components)
    resolution = network.component_resolution(components, fluxes, sales.long())
    resolved = network.resolved_components(resolution, "Mortality and Growth")
    nodes = network.foodweb_nodes(info, components, resolved)
    return nodes.select("id", "FullName", "Colour", "is_resolved", "opacity",
                        F.col("x").alias("pos_x"), F.col("y").alias("pos_y"))


def register_series(sales):
    """Biomass of all regions, then consumption of all consumers, then biomass
    of all components with metadata: only what is new is added."""
    registry = sales.spark.createDataFrame([], REGISTRY)
    measured = sales.biomass().select(F.col("Var").alias("Component"))
    eaters = sales.flux().select(F.col("dst").alias("Component"))
    registry = store.register_series(registry, "Biomass", measured)
    registry = store.register_series(registry, "Consumption", eaters)
    known = metadata_clean(sales).select(F.col("ID").alias("Component"))
    return store.register_series(registry, "Biomass", known)


def upsert_quantiles(sales):
    """A store of fluxes and biomasses; a later run replaces the biomasses and
    adds the group."""
    scratch = Scratch(sales.spark)
    biomass = scratch.keep(series_run("Biomass")(sales))
    old = series_run("Fluxes")(sales).unionByName(biomass)
    new = biomass.withColumn("Value", F.round(F.col("Value") * 2, 9))
    again = scratch.keep(series_run("Biomass", group=True)(sales))
    return store.upsert_quantiles(store.upsert_quantiles(old, new), again)


def export_series(sales):
    kept = series_run("Ratio Production/Biomass")(sales).unionByName(series_run("Biomass")(sales))
    wanted = register_series(sales).filter("Variable = 'Biomass'").unionByName(
        sales.flux().select(F.lit("Ratio Production/Biomass").alias("Variable"), F.col("src").alias("Component")).distinct()
    )
    return store.export_rows(kept, wanted)


def long_table(sales):
    path = f"{Scratch(sales.spark).path}/long"
    trajectories.write_long(sales.long(), path)
    return trajectories.read_long(sales.spark, path).drop("Trophic")


def metadata_file(sales):
    path = f"{Scratch(sales.spark).path}/info"
    write_metadata(sales.raw_info().withColumnRenamed("Color", "Colour"), path)
    return read_metadata(sales.spark, path)


def quantile_store(sales):
    """A stored run, parts of which two later runs replace on disk."""
    scratch = Scratch(sales.spark)
    path = f"{scratch.path}/store"
    biomass = scratch.keep(series_run("Biomass")(sales))
    store.write_quantiles(biomass.unionByName(series_run("Fluxes")(sales)), path)
    store.write_quantiles(biomass.withColumn("Value", F.round(F.col("Value") * 2, 9)), path)
    store.write_quantiles(series_run("Biomass", group=True)(sales), path)
    return store.read_quantiles(sales.spark, path).drop("Prey", "Predator", "Metric")


def export_csv(sales):
    path = f"{Scratch(sales.spark).path}/csv"
    kept = series_run("Ratio Production/Biomass")(sales).unionByName(series_run("Biomass")(sales))
    wanted = kept.select(F.col("Var").alias("Variable"), F.col("ID").alias("Component")).distinct()
    folders = store.export_series(kept, wanted, path)
    return sales.spark.read.csv(
        [f"{path}/{f}" for f in folders], header=True, nullValue="NA",
        schema="Year int, Var string, Unit string, ID string, Stat string, Value double",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    runs = {
        "wide_scan": wide_scan,
        "model_tables": model_tables,
        "validate_model": validate,
        "to_long": to_long,
        "metadata_clean": metadata_clean,
        "metadata_reconcile": metadata_reconcile,
        "component_resolution": _resolution,
        "resolved_components": resolved_components,
        "select_valid": select_valid,
        "quantile_summary": summary,
        "quantile_selection": selection,
        "quantile_sketch": sketched,
        "quantiles_long": summary_long,
        "trajectory_sample": trajectory_sample,
        "random_lines": random_lines,
        "proportion_by_year": proportion_by_year,
        "proportion_consumption": proportion_consumption,
        "proportion_biomass": proportion_biomass,
        "proportion_flux": proportion_flux,
        "beta_params": _beta(False),
        "beta_params_share": _beta(True),
        "beta_bands": _bands(True),
        "beta_bands_rate": _bands(False),
        "flux_colours": flux_colours,
        "analyze_all": _analyze,
        "analyze_grouped": lambda sales: _analyze(sales, group=True),
        "foodweb_nodes": foodweb_nodes,
        "foodweb_edges": lambda sales: network.foodweb_edges(sales.fluxes()),
        "register_series": register_series,
        "upsert_quantiles": upsert_quantiles,
        "export_series": export_series,
        "long_table": long_table,
        "metadata_file": metadata_file,
        "quantile_store": quantile_store,
        "export_csv": export_csv,
    }
    for key, variable in SERIES_KEYS.items():
        runs[key] = series_run(variable)
        runs[f"{key}_grouped"] = series_run(variable, group=True)
    found = {name: _on_folder(run) for name, run in runs.items()}
    if training:
        found |= training.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def _on_folder(run):
    return lambda spark, folder: run(Sales(spark, folder))


SERIES_KEYS = {
    "biomass_series": "Biomass",
    "consumption_series": "Consumption",
    "predation_series": "Predation and Fisheries",
    "flux_series": "Fluxes",
    "cb_ratio": "Ratio Consumption/Biomass",
    "pb_ratio": "Ratio Production/Biomass",
    "mortality_growth": "Mortality and Growth",
}


# --- SQL twins ------------------------------------------------------------

WEB = """
with ord as (
  select o_orderkey, o_custkey, cast(year(o_orderdate) as int) as yr,
         cast(o_orderkey // 250 + 1 as bigint) as sid, o_totalprice,
         o_orderpriority = '1-URGENT' as urgent
  from orders),
cust as (
  select c_custkey, 'R' || n_regionkey as reg, 'F' || c_mktsegment as fleet
  from customer join nation on c_nationkey = n_nationkey),
supp as (
  select s_suppkey, 'R' || n_regionkey as reg
  from supplier join nation on s_nationkey = n_nationkey),
bio as (
  select sid, reg, yr, cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100000 as val
  from ord join cust on o_custkey = c_custkey group by all),
flx as (
  select sid, supp.reg as src, case when urgent then fleet else cust.reg end as dst, yr,
         cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / 100000 as val
  from lineitem join ord on l_orderkey = o_orderkey
       join cust on o_custkey = c_custkey join supp on l_suppkey = s_suppkey
  group by all),
long as (
  select sid as Sample_id, 'component' as kind, reg as Var, cast(null as varchar) as src,
         cast(null as varchar) as dst, yr as "Year", val as value from bio
  union all
  select sid, 'flux', src || '_' || dst, src, dst, yr, val from flx),
fluxes as (
  select 'X' || row_number() over (order by src || '_' || dst) as Flux, src as "From", dst as "To"
  from (select distinct src, dst from flx)),
components as (
  select Component, case when Component like 'R%' then 1 else 0 end as Inside,
         row_number() over (order by Component) / 16.0::double as X,
         row_number() over (order by Component) / 32.0::double as Y
  from (select "From" as Component from fluxes union select "To" from fluxes)),
regions as (
  select distinct r_regionkey, r_name
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
clean as (
  select 'R' || r_regionkey as ID, r_name as FullName, '#00000' || r_regionkey as Colour from regions
  union all
  select 'Z' || count(*), '', '' from regions),
info as (
  select * from clean where ID in (select Component from components)
  union all
  select Component, Component, list_extract({palette}, cast((row_number() over (order by Component) - 1) % 14 + 1 as int))
  from components where Component not in (select ID from clean)),
lab as (select ID as lid, FullName as label, Colour as lcol from info),
resolution as (
  select Component,
         Component in (select Var from long) as IsBiomass,
         Component in (select "To" from fluxes) as IsConsumer,
         Component in (select "From" from fluxes) as IsPredatedCatched,
         coalesce((select bool_and("To" like 'F%') from fluxes where "From" = Component), false) as IsCatchedOnly,
         coalesce((select bool_and("To" not like 'F%') from fluxes where "From" = Component), false) as IsPredatedOnly
  from components),
""".replace("{palette}", str(list(metadata.PALETTE)))


def _quant_sql(source, variable, unit, keys, label=None):
    extra = [k for k in keys if k not in ("Year", "ID")]
    extras = "".join(f', "{e}"' for e in extra)
    ident = f"'{label}'" if label else "ID"
    group = ", ".join(f'"{k}"' for k in keys if not (label and k == "ID"))
    return f"""
  select "Year", '{variable}' as "Var", '{unit}' as "Unit", {ident} as "ID"{extras},
         unnest({list(STATS)}) as "Stat", unnest(q) as v
  from (select {group}, quantile_cont(value, [0, 0.025, 0.25, 0.5, 0.75, 0.975, 1]) as q
        from {source} group by {group})"""


def _flow_sql(variable, focus, other, extra, all_label, group):
    flows = f"""
flows as (select "Year", Sample_id, {focus} as ID, label as "{extra}", lcol, value
          from long join lab on lid = {other} where kind = 'flux'),"""
    if group:
        flows = flows.replace("flows as", "raw as") + f"""
flows as (select "Year", Sample_id, "{extra}", lcol, sum(value) as value
          from raw group by "Year", Sample_id, "{extra}", lcol),"""
    ident = "" if group else ", ID"
    label = LABEL if group else None
    return flows + f"""
total as (select "Year", Sample_id{ident}, '{all_label}' as "{extra}", sum(value) as value
          from flows group by "Year", Sample_id{ident}),
quant as ({_quant_sql("total", variable, "1000t", ["Year", "ID", extra], label)}
  union all {_quant_sql("flows", variable, "1000t", ["Year", "ID", extra], label)})"""


def _ratio_sql(variable, side, group):
    ident, label = ("", LABEL) if group else (", ID", None)
    return f"""
b as (select Sample_id, Var as ID, "Year", value as biomass from long where kind = 'component'),
f as (select Sample_id, {side} as ID, "Year", sum(value) as flow from long
      where kind = 'flux' and {side} like 'R%' group by all),
merged as (select Sample_id, ID, "Year", coalesce(biomass, 0) as biomass, coalesce(flow, 0) as flow
           from b full join f using (Sample_id, ID, "Year")),
kept as (select * from merged where "Year" <> (select max("Year") from merged)),
cells as (select Sample_id{ident}, "Year", sum(flow) / sum(biomass) as value from kept
          group by Sample_id{ident}, "Year"),
quant as ({_quant_sql("cells", variable, "Unitless", ["Year", "ID"], label)})"""


def _rates_sql(group):
    ident = f"'{LABEL}'" if group else "Var"
    source = f"'{LABEL}'" if group else "src"
    return f"""
b as (select Sample_id, {ident} as ID, "Year", sum(value) as B from long where kind = 'component' group by all),
f as (select Sample_id, {source} as ID, "Year",
             sum(value) filter (where dst like 'F%') as C, sum(value) filter (where dst not like 'F%') as P
      from long where kind = 'flux' group by all),
cells as (
  select b.Sample_id, b.ID, b."Year", b.B, n.B as B1, C, P
  from (select *, max("Year") over (partition by Sample_id, ID) as last from b) b
  left join b n on n.Sample_id = b.Sample_id and n.ID = b.ID and n."Year" = b."Year" + 1
  left join f on f.Sample_id = b.Sample_id and f.ID = b.ID and f."Year" = b."Year"
  where b."Year" < b.last),
zed as (select *, -ln(B1 / (B1 + C + P)) as Z, ln((B1 + C + P) / B) as G from cells),
rates as (select Sample_id, ID, "Year", Z, C / (C + P) * Z as F, P / (C + P) * Z as M, G from zed)"""


def _mortality_sql(group):
    metrics = "('Z', 'Total Mortality'), ('F', 'Fishing Mortality'), ('M', 'Natural Mortality'), ('G', 'Growth')"
    return _rates_sql(group) + f""",
melted as (
  select "Year", ID, m.name as "Metric",
         case m.rate when 'Z' then Z when 'F' then F when 'M' then M else G end as value
  from rates, (values {metrics}) m(rate, name)),
quant as ({_quant_sql("melted", "Mortality and Growth", "Rate (y-1)", ["Year", "ID", "Metric"])})"""


def _series_sql(variable, group=False):
    if variable in ("Biomass", "Fluxes"):
        kind = "component" if variable == "Biomass" else "flux"
        if group:
            return f"""
cells as (select "Year", Sample_id, sum(value) as value from long where kind = '{kind}' group by all),
quant as ({_quant_sql("cells", variable, "1000t", ["Year", "ID"], LABEL)})"""
        return f"""
cells as (select "Year", Sample_id, Var as ID, value from long where kind = '{kind}'),
quant as ({_quant_sql("cells", variable, "1000t", ["Year", "ID"])})"""
    if variable == "Consumption":
        return _flow_sql(variable, "dst", "src", "Prey", "All prey", group)
    if variable == "Predation and Fisheries":
        return _flow_sql(variable, "src", "dst", "Predator", "All predators", group)
    if variable == "Mortality and Growth":
        return _mortality_sql(group)
    return _ratio_sql(variable, "dst" if "Consumption" in variable else "src", group)


def _quant_select(variable):
    columns = ", ".join(f'"{c}"' for c in quant_columns(variable)[:-1])
    return f'select {columns}, round(v, 9) as "Value" from quant'


def _named_sql(source, keys):
    names = ", ".join(
        f'round(q[{i}], 9) as {s.replace(".", "_")}' for i, s in enumerate(STATS, 1)
    )
    return f"""select {keys}, {names} from (
  select {keys}, quantile_cont(value, [0, 0.025, 0.25, 0.5, 0.75, 0.975, 1]) as q from {source} group by {keys})"""


def _share_sql(kind):
    return f"""
m as (select "Year", Var as ID, avg(value) as value from long where kind = '{kind}' group by all)
select "Year", ID as "ID", round(value, 3) as value,
       round(value / sum(value) over (partition by "Year"), 9) as proportion from m"""


def _fit_sql(share):
    x = "case when F + M <> 0 then F / (F + M) end" if share else "F"
    return WEB + _rates_sql(False) + f""",
moments as (select "Year", ID, avg({x}) as m, var_samp({x}) as v from rates group by all),
fit as (select *, greatest(greatest(m * (1 - m), 1e-8) / greatest(v, 1e-8) - 1, 1e-8) as t,
               m > 1e-8 and m < 1 - 1e-8 and v is not null as ok from moments)"""


def _beta_cdf_sql(x, a, b):
    """Incomplete beta function by its power series, at the side of the mean where it converges fast."""
    def series(x, a, b):
        return f"""exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b}))
          * list_sum(list_transform(range(0, 500), lambda n:
              exp(lgamma({a} + {b} + n) - lgamma({a} + {b}) - lgamma({a} + 1 + n) + lgamma({a} + 1) + n * ln({x}))))"""

    low, high = series(x, a, b), series(f"(1 - {x})", b, a)
    return f"case when {x} * ({a} + {b} + 2) <= {a} + 1 then {low} else 1 - {high} end"


def _bands_sql(share):
    def unless_flat(fit, at0, at1):
        return f"round(case when m <= 1e-8 then {at0} when m >= 1 - 1e-8 then {at1} else {fit} end, 6)"

    fit = _fit_sql(share).strip().removeprefix("with")
    return f"""
with recursive {fit},
params as (select "Year", ID, m, case when ok then greatest(m * t, 1e-8) end as a,
                  case when ok then greatest((1 - m) * t, 1e-8) end as b from fit),
search as (
  select "Year", ID, a, b, p, 0.0::double as lo, 1.0::double as hi, 0 as step
  from params, (values (0.05::double), (0.95::double)) v(p) where a is not null
  union all
  select "Year", ID, a, b, p, case when cdf < p then mid else lo end, case when cdf < p then hi else mid end, step + 1
  from (select *, {_beta_cdf_sql("mid", "a", "b")} as cdf from (select *, (lo + hi) / 2 as mid from search) where step < 50)),
quantiles as (
  select "Year", ID, max((lo + hi) / 2) filter (where p < 0.5) as q05, max((lo + hi) / 2) filter (where p > 0.5) as q95
  from search where step = 50 group by all),
bins as (select *, (k + 0.5) / 1000.0::double as x from params, (select unnest(range(0, 1000)) as k)),
below as (select *, {_beta_cdf_sql("x", "a", "b")} as c from bins)
select "Year", ID as "ID", k / 1000.0::double as y0, (k + 1) / 1000.0::double as y1,
       {unless_flat("1 - c", 0.0, 1.0)} as bottom, {unless_flat("c", 1.0, 0.0)} as top,
       {unless_flat("a / (a + b)", 0.0, 1.0)} as "mean_F",
       {unless_flat("q05", 0.0, 1.0)} as q05, {unless_flat("q95", 0.0, 1.0)} as q95
from below left join quantiles using ("Year", ID)"""


def _beta_sql(share):
    return _fit_sql(share) + """
select "Year", ID as "ID", round(m, 9) as mean, round(v, 9) as var,
       case when ok then round(greatest(m * t, 1e-8), 9) end as a,
       case when ok then round(greatest((1 - m) * t, 1e-8), 9) end as b from fit"""


MORTALITY_ELIGIBLE = "IsBiomass and IsPredatedCatched and IsConsumer and not IsCatchedOnly and not IsPredatedOnly"


def _resolved_sql():
    return f"""
select v as "Variable", Component as "Component" from resolution, (values
  ('Biomass'), ('Consumption'), ('Predation and Fisheries'), ('Ratio Consumption/Biomass'),
  ('Ratio Production/Biomass'), ('Mortality and Growth')) t(v)
where case v when 'Biomass' then IsBiomass
             when 'Consumption' then IsConsumer
             when 'Predation and Fisheries' then IsPredatedCatched
             when 'Ratio Consumption/Biomass' then IsConsumer and IsBiomass
             when 'Ratio Production/Biomass' then IsPredatedCatched and IsBiomass
             else {MORTALITY_ELIGIBLE} end"""


REGISTRY_SQL = """
registry as (
  select 'Biomass' as "Variable", reg as "Component" from bio
  union select 'Consumption', dst from flx
  union select 'Biomass', ID from clean)"""


def _checks_sql():
    names = ["mcmc", "mcmc columns", "components_param", "species", "fluxes_def", "ntstep"]
    names += ["components_param columns", "fluxes_def columns", "column names"]
    rows = []
    for name in names:
        rows.append(f"select 'good' as model, '{name}' as \"check\", true as ok, cast(null as varchar) as message")
        if name == "fluxes_def columns":
            rows.append(f"select 'bad', '{name}', false, 'fluxes_def needs the columns Flux, From and To'")
        else:
            rows.append(f"select 'bad', '{name}', true, null")
    rows += [
        "select 'good', 'components_param unique Component', max(n) <= 1, case when max(n) > 1 then"
        " 'Component occurs more than once in components_param' end"
        " from (select count(*) n from components group by Component)",
        "select 'good', 'fluxes_def unique Flux', max(n) <= 1, case when max(n) > 1 then"
        " 'Flux occurs more than once in fluxes_def' end from (select count(*) n from fluxes group by Flux)",
        "select 'bad', 'components_param unique Component', max(n) <= 1, case when max(n) > 1 then"
        " 'Component occurs more than once in components_param' end"
        " from (select 2 * count(*) n from components group by Component)",
    ]
    return " union all ".join(rows)


def oracle_sql() -> dict[str, str]:
    end = "last_part as (select 1)\n"
    wide = """
ids as (select sid, (sid - 1) % 4 + 1 as chain, (sid - 1) // 4 + 1 as it from (select distinct sid from ord)),
numbered as (select sid, cast(chain as int) as chain, it,
                    row_number() over (order by chain, it) as Sample_id from ids)"""
    sql = {
        "wide_scan": WEB + wide + """
select n.chain, n.it as iter, n.Sample_id as "Sample_id", count(*) as cells, round(sum(value), 6) as total
from long l join numbered n on n.sid = l.Sample_id group by all""",
        "to_long": WEB + wide + """,
cols as (select distinct kind, Var, src, dst, "Year" from long)
select n.Sample_id as "Sample_id", c.kind, c.Var as "Var", c.src, c.dst, c."Year", l.value
from numbered n cross join cols c
left join long l on l.Sample_id = n.sid and l.Var = c.Var and l."Year" = c."Year\"""",
        "model_tables": WEB + end + """
select 'component' as kind, Component as name, null as "From", null as "To", Inside as "Inside", X as "X", Y as "Y"
from components
union all select 'flux', Flux, "From", "To", null, null, null from fluxes""",
        "validate_model": WEB + end + _checks_sql(),
        "metadata_clean": WEB + end + 'select ID as "ID", FullName as "FullName", Colour as "Colour" from clean',
        "metadata_reconcile": WEB + end + 'select ID as "ID", FullName as "FullName", Colour as "Colour" from info',
        "component_resolution": WEB + end + "select * from resolution",
        "resolved_components": WEB + end + _resolved_sql(),
        "select_valid": WEB + end + """
select ID as "Component" from clean where ID in (
  select Component from resolution where IsConsumer and IsBiomass)""",
        "quantile_summary": WEB + """
cells as (select "Year", Var as "ID", value from long where kind = 'component')
""" + _named_sql("cells", '"Year", "ID"'),
        "quantile_selection": WEB + end + _named_sql("long", '"Year", kind'),
        "quantile_sketch": WEB + end + """
select "Year", kind, stat as "Stat", count(*) as n_values, true as is_close
from long cross join (values ('q0'), ('q2.5'), ('q25'), ('q50'), ('q75'), ('q97.5'), ('q100')) s(stat)
group by all""",
        "random_lines": WEB + """
drawn as (
  select sid, row_number() over (order by sid) as slot
  from (select distinct Sample_id as sid from long order by md5('7:' || Sample_id), Sample_id limit 3))
select case kind when 'component' then 'Biomass' else 'Fluxes' end as "Var", "Year", Var as "ID",
       max(value) filter (where slot = 1) as "S1", max(value) filter (where slot = 2) as "S2",
       max(value) filter (where slot = 3) as "S3"
from long join drawn on sid = Sample_id group by all""",
        "quantiles_long": WEB + f"""
cells as (select "Year", src as ID, value from long where kind = 'flux'),
quant as ({_quant_sql("cells", "Fluxes by prey", "1000t", ["Year", "ID"])})
select "Year", "Var", "Unit", "ID", "Stat", round(v, 9) as "Value" from quant""",
        "trajectory_sample": WEB + """
b as (select Sample_id, Var as ID, "Year", value as biomass from long
      where kind = 'component' and Sample_id in (2, 3, 5)),
f as (select Sample_id, dst as ID, "Year", sum(value) as flow from long
      where kind = 'flux' and dst like 'R%' and Sample_id in (2, 3, 5) group by all),
r as (select Sample_id, ID, "Year", coalesce(flow, 0) / coalesce(biomass, 0) as value
      from b full join f using (Sample_id, ID, "Year")
      where "Year" <> (select max("Year") from long where kind = 'component' or dst like 'R%'))
select "Year", ID as "ID", round(max(value) filter (where Sample_id = 2), 9) as "S1",
       round(max(value) filter (where Sample_id = 3), 9) as "S2",
       round(max(value) filter (where Sample_id = 5), 9) as "S3" from r group by all""",
        "proportion_by_year": WEB + """
m as (select "Year", src as ID, label as target, lcol as Colour_target, avg(value) as value
      from long join lab on lid = dst where kind = 'flux' group by all)
select "Year", ID as "ID", target, Colour_target as "Colour_target", round(value, 3) as value,
       round(value / sum(value) over (partition by ID, "Year"), 9) as proportion from m""",
        "proportion_consumption": WEB + """
m as (select "Year", dst as ID, label as target, lcol as Colour_target, avg(value) as value
      from long join lab on lid = src where kind = 'flux' group by all)
select "Year", ID as "ID", target, Colour_target as "Colour_target", round(value, 3) as value,
       round(value / sum(value) over (partition by ID, "Year"), 9) as proportion from m""",
        "proportion_biomass": WEB + _share_sql("component"),
        "proportion_flux": WEB + _share_sql("flux"),
        "beta_params": _beta_sql(False),
        "beta_params_share": _beta_sql(True),
        "beta_bands": _bands_sql(True),
        "beta_bands_rate": _bands_sql(False),
        "flux_colours": WEB + f"""
series as (select 'From ' || p.label || ' to ' || q.label as series, "To" as t, "From" as s
           from fluxes join lab p on p.lid = "From" join lab q on q.lid = "To")
select series, list_extract({list(network.FLUX_PALETTE)},
         cast((row_number() over (order by t, s) - 1) % 51 + 1 as int)) as "Colour" from series""",
        "foodweb_nodes": WEB + """
eligible as (select Component as e from resolution where """ + MORTALITY_ELIGIBLE + """)
select ID as id, FullName as "FullName", Colour as "Colour", ID in (select e from eligible) as is_resolved,
       case when ID in (select e from eligible) then 1.0::double else 0.4::double end as opacity,
       X * 1000 as pos_x, Y * 1000 as pos_y
from info join components on ID = Component""",
        "foodweb_edges": WEB + end + 'select Flux as id, Flux as label, "From" as "from", "To" as "to" from fluxes',
        "register_series": WEB + REGISTRY_SQL + "\nselect * from registry",
    }
    for key, variable in SERIES_KEYS.items():
        select = "\n" + _quant_select(variable)
        sql[key] = WEB + _series_sql(variable) + select
        sql[f"{key}_grouped"] = WEB + _series_sql(variable, group=True) + select

    wide_columns = ["Year", "Var", "Unit", "ID", "Prey", "Predator", "Metric", "Stat"]
    for name, suffix in (("analyze_all", ""), ("analyze_grouped", "_grouped")):
        parts = []
        for key, variable in SERIES_KEYS.items():
            has = quant_columns(variable)
            columns = ", ".join(f'"{c}"' if c in has else f'null as "{c}"' for c in wide_columns)
            parts.append(f'select {columns}, "Value" from ({sql[key + suffix]})')
        sql[name] = " union all ".join(parts)
    sql["upsert_quantiles"] = f"""
select * from ({sql["flux_series"]})
union all select "Year", "Var", "Unit", "ID", "Stat", round("Value" * 2, 9) as "Value" from ({sql["biomass_series"]})
union all select * from ({sql["biomass_series_grouped"]})"""
    sql["export_series"] = f"""
select *, 'Biomass' as file from ({sql["biomass_series"]})
union all select *, 'Ratio_Production_Biomass' from ({sql["pb_ratio"]})"""
    sql["long_table"] = WEB + end + """
select Sample_id as "Sample_id", kind, Var as "Var", src, dst, "Year", value from long"""
    sql["metadata_file"] = sql["metadata_clean"]
    sql["quantile_store"] = sql["upsert_quantiles"]
    sql["export_csv"] = f"""
select * from ({sql["biomass_series"]}) union all select * from ({sql["pb_ratio"]})"""
    if training:
        sql |= training.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
