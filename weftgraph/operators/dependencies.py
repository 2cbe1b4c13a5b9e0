"""Dependencies between components from facts about fields and method signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.scalar import dependency_score

#: Annotations of an injected field (fixed values).
INJECTING = ("Inject", "EJB", "Resource", "Autowired", "PersistenceContext")


def extract(components: DataFrame, supertypes: DataFrame, fields: DataFrame, signatures: DataFrame) -> DataFrame:
    """from_id, to_id, kind, derived_from, confidence: one dependency of each pair, the first that the sources tell.

    components: id, qualified_name, type, module.  supertypes: type, supertype, is_class.  fields: ord, owner, type,
    annotations, is_final.  signatures: ord, owner, type (of a result, a parameter or an argument of either's type).
    A field's type that is no component stands for its single direct implementor, if it has just one; such a
    final field counts as injected by the constructor.  A type's fields come before its methods.
    """
    of = components.select(F.col("qualified_name").alias("type"), F.col("id").alias("to_id"), F.col("type").alias("to_type"), F.col("module").alias("to_module"))
    owner = components.select(F.col("qualified_name").alias("owner"), F.col("id").alias("from_id"), F.col("module").alias("from_module"))
    single = supertypes.where("not is_class").select("type", "supertype").join(of.select("type"), "type", "left_semi").groupBy("supertype").agg(F.count("*").alias("n"), F.min("type").alias("implementor")).where("n = 1")

    held = fields.join(owner, "owner").withColumn("marked", F.coalesce(F.arrays_overlap("annotations", F.array(*map(F.lit, INJECTING))), F.lit(False)))
    direct = held.join(of, "type").withColumn("injected", F.col("marked"))
    unknown = held.join(of.select("type"), "type", "left_anti").join(single.select(F.col("supertype").alias("type"), "implementor"), "type").drop("type").withColumnRenamed("implementor", "type")
    implied = unknown.join(of, "type").withColumn("injected", F.col("marked") | F.coalesce("is_final", F.lit(False)))
    same = F.col("from_module") == F.col("to_module")
    by_field = direct.unionByName(implied, allowMissingColumns=True).select(
        "from_id", "to_id", F.lit(0).alias("place"), "ord", F.when(F.col("injected"), "injection").otherwise("field-reference").alias("kind"),
        F.when(F.col("injected"), "annotation").otherwise("type-relation").alias("derived_from"), dependency_score(F.col("injected"), same, F.col("to_type")).alias("confidence"),
    )
    by_signature = signatures.join(owner, "owner").join(of, "type").select("from_id", "to_id", F.lit(1).alias("place"), "ord", F.lit("type-usage").alias("kind"), F.lit("method-signature").alias("derived_from"), F.lit(0.5).alias("confidence"))
    every = by_field.unionByName(by_signature).where("from_id <> to_id")
    first = every.groupBy("from_id", "to_id").agg(F.min_by(F.struct("kind", "derived_from", "confidence"), F.struct("place", "ord")).alias("d"))
    return first.select("from_id", "to_id", "d.*")
