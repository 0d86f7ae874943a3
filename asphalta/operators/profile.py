"""Column profiles, data dictionary, duplicates and quality logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import median_of_ranked, ranked_long, top_per_group
from .shape import NUMERIC, quoted

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def type_class(kind: T.DataType) -> str:
    if isinstance(kind, WHOLE):
        return "entier"
    if isinstance(kind, NUMERIC):
        return "numerique"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "texte"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def unpivot_row(df: DataFrame, fields: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One aggregate over many columns, turned into one row per column."""
    names = list(fields)
    metrics = list(next(iter(fields.values())))
    wide = df.agg(*[fields[n][m].alias(f"m{i}_{m}") for i, n in enumerate(names) for m in metrics])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("colonne"), *[F.col(f"m{i}_{m}").alias(m) for m in metrics])
        for i, n in enumerate(names)])).alias("p")).select("p.*")


def fill_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Filled rows, total and percentage per column in one aggregate."""
    n = F.count(F.lit(1))
    return unpivot_row(df, {
        c: {"renseignees": F.count(quoted(c)), "total": n,
            "pct": F.coalesce(F.try_divide(F.count(quoted(c)) * 100.0, n), F.lit(0.0))}
        for c in (columns or df.columns)})


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(colonne, valeur, n) of several columns from one grouped pass."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("colonne"), quoted(c).cast("string").alias("valeur"))
        for c in columns])).alias("p")
    return (df.select(pairs).select("p.*").where(F.col("valeur").isNotNull())
            .groupBy("colonne", "valeur").agg(F.count(F.lit(1)).alias("n")))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """The k most frequent values per column."""
    return top_per_group(value_counts(df, columns), ["colonne"],
                         [F.col("n").desc(), F.col("valeur").asc()], k)


def column_profile(df: DataFrame) -> DataFrame:
    """Type, counts, distinct values, moments, exact median and top values per column.

    Counts and moments are one aggregate; distinct values, medians and top values
    are read off the counts of distinct values.
    """
    numbers, texts = numeric_columns(df), text_columns(df)
    n = F.count(F.lit(1))
    null_double = F.lit(None).cast("double")

    def basics(c: str) -> dict[str, Column]:
        filled = F.count(quoted(c))
        missing = n - filled
        num = c in numbers
        return {
            "nb_valeurs": filled, "nb_manquants": missing,
            "pct_manquants": F.coalesce(F.round(F.try_divide(missing * 100.0, n), 2), F.lit(0.0)),
            "min": F.min(quoted(c)).cast("double") if num else null_double,
            "max": F.max(quoted(c)).cast("double") if num else null_double,
            "moyenne": F.round(F.avg(quoted(c)), 3) if num else null_double,
            "ecart_type": F.round(F.stddev_samp(quoted(c)), 3) if num else null_double,
            "nb_lignes": n}

    base = unpivot_row(df, {c: basics(c) for c in df.columns})
    counts = value_counts(df, df.columns)
    distinct = counts.groupBy("colonne").agg(F.count(F.lit(1)).alias("nb_uniques"))
    out = base.join(distinct, "colonne", "left").na.fill({"nb_uniques": 0})
    if texts:
        tops = top_per_group(counts.where(F.col("colonne").isin(texts)), ["colonne"],
                             [F.col("n").desc(), F.col("valeur").asc()], 3)
        shown = F.struct("rang", F.concat("valeur", F.lit(" ("), F.col("n").cast("string"),
                                          F.lit(")")).alias("t"))
        tops = tops.groupBy("colonne").agg(
            F.array_join(F.array_sort(F.collect_list(shown)).getField("t"), "; ")
            .alias("top_3_valeurs"))
        out = out.join(tops, "colonne", "left")
    else:
        out = out.withColumn("top_3_valeurs", F.lit(None).cast("string"))
    if numbers:
        medians = ranked_long(df, [], numbers).groupBy(F.col("variable").alias("colonne")).agg(
            median_of_ranked().alias("mediane"))
        out = out.join(medians, "colonne", "left")
    else:
        out = out.withColumn("mediane", null_double)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return out.select(
        "colonne", F.element_at(kind, F.col("colonne")).alias("type"), "nb_valeurs",
        "nb_manquants", "pct_manquants", "nb_uniques", "min", "max", "moyenne", "mediane",
        "ecart_type", "top_3_valeurs", "nb_lignes")


def dataset_summary(profile: DataFrame, name: str) -> DataFrame:
    """Rows, columns, columns with gaps and fully unique columns of one profile."""
    return profile.agg(
        F.lit(name).alias("dataset"), F.max("nb_lignes").alias("nb_lignes"),
        F.count(F.lit(1)).alias("nb_colonnes"),
        F.count_if(F.col("nb_manquants") > 0).alias("colonnes_avec_manquants"),
        F.count_if(F.col("nb_uniques") == F.col("nb_lignes")).alias("colonnes_100pct_uniques"))


def data_dictionary(df: DataFrame, source: str, file: str) -> DataFrame:
    """Type class, counts, gaps and an example per column.

    The example is the smallest value, so that it does not depend on file order.
    """
    n = F.count(F.lit(1))
    rows = unpivot_row(df, {c: {
        "nb_valeurs": n, "nb_manquantes": n - F.count(quoted(c)),
        "pct_manquantes": F.coalesce(F.round(F.try_divide(
            (n - F.count(quoted(c))) * 100.0, n), 2), F.lit(0.0)),
        "exemple": F.min(quoted(c)).cast("string")} for c in df.columns})
    kinds = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, type_class(f.dataType))])
    return rows.select(
        F.lit(source).alias("source"), F.lit(file).alias("fichier"),
        F.col("colonne").alias("variable"),
        F.element_at(kinds, F.col("colonne")).alias("type"),
        "nb_valeurs", "nb_manquantes", "pct_manquantes", "exemple")


# Join-key notes, units and descriptions of known variables.
KEY_NOTES = {
    "Num_Acc": "OUI - identifiant accident",
    "Id_Accident": "A vérifier - correspondance accident",
    "iu_ac": "OUI - identifiant tronçon / arc",
    "AAAAMMJJ": "OUI - clé de date",
    "GEO": "OUI - code géographique",
}
UNITS = {
    "q": "véhicules/heure", "k": "%", "RR": "mm",
    "TN": "°C", "TX": "°C", "TM": "°C", "TAMPLI": "°C",
}
DESCRIPTIONS = {
    "Num_Acc": "Identifiant unique de l'accident",
    "lum": "Conditions de luminosité au moment de l'accident",
    "atm": "Conditions atmosphériques au moment de l'accident",
    "col": "Type de collision",
    "lat": "Latitude du lieu de l'accident",
    "long": "Longitude du lieu de l'accident",
    "grav": "Gravité de l'accident ou de l'usager",
    "catu": "Catégorie de l'usager",
    "secu1": "Premier équipement de sécurité utilisé",
    "secu2": "Deuxième équipement de sécurité",
    "secu3": "Troisième équipement de sécurité",
    "Id_Accident": "Identifiant de l'accident dans le fichier des véhicules immatriculés",
    "iu_ac": "Identifiant de l'arc ou du tronçon routier",
    "q": "Débit de circulation",
    "k": "Taux d'occupation du trafic",
    "etat_trafic": "État du trafic",
    "etat_barre": "État de la barre ou du capteur",
    "t_1h": "Horodatage de la mesure de trafic",
    "AAAAMMJJ": "Date de la mesure météorologique au format AAAAMMJJ",
    "RR": "Quantité de précipitations",
    "TN": "Température minimale",
    "TX": "Température maximale",
    "TM": "Température moyenne",
    "TAMPLI": "Amplitude thermique",
    "GEO": "Code géographique",
    "GEO_OBJECT": "Type d'objet géographique",
    "FREQ": "Fréquence de la donnée",
    "POPREF_MEASURE": "Type de mesure de population",
    "TIME_PERIOD": "Période de référence",
    "OBS_VALUE": "Valeur observée de la population",
}


def enrich_dictionary(dictionary: DataFrame, keys: Mapping[str, str] = KEY_NOTES,
                      units: Mapping[str, str] = UNITS,
                      descriptions: Mapping[str, str] = DESCRIPTIONS) -> DataFrame:
    """Three lookups by variable name, '' where nothing is known."""
    spark = dictionary.sparkSession
    out = dictionary
    for name, table in (("cle_jointure", keys), ("unite", units), ("description", descriptions)):
        lookup = spark.createDataFrame(list(table.items()), f"variable string, {name} string")
        out = out.join(F.broadcast(lookup), "variable", "left").na.fill({name: ""})
    return out


def duplicate_counts(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """Rows beyond the first per whole row and per key."""
    def extra(columns: Sequence[str], name: str) -> DataFrame:
        groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias(name))

    one = F.lit(source).alias("source")
    whole = extra(df.columns, "doublons_totaux").select(one, "doublons_totaux")
    return whole.join(extra(keys, "doublons_cle").select(one, "doublons_cle"), "source")


def before_after(raw: DataFrame, cleaned: DataFrame, source: str) -> DataFrame:
    """Rows and columns before and after cleaning, percentage kept."""
    def size(df: DataFrame, label: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(f"lignes_{label}")).select(
            F.lit(source).alias("source"), f"lignes_{label}",
            F.lit(len(df.columns)).alias(f"colonnes_{label}"))

    both = size(raw, "raw").join(size(cleaned, "curated"), "source")
    return both.withColumn("pct_lignes_conservees", F.round(F.try_divide(
        F.col("lignes_curated") * 100.0, F.col("lignes_raw")), 1))


def grain_check(fact: DataFrame, enriched: DataFrame, key: str) -> DataFrame:
    """Rows of fact and enriched fact, distinct ids, and whether all agree."""
    one = F.lit(1)
    left = fact.agg(F.count(one).alias("n_fait")).withColumn("_j", one)
    per_id = enriched.groupBy(key).agg(F.count(one).alias("_n"))
    right = per_id.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_enrichi"),
                       F.count(key).alias("n_distinct_id")).withColumn("_j", one)
    return left.join(right, "_j").drop("_j").withColumn(
        "grain_ok", (F.col("n_fait") == F.col("n_enrichi"))
        & (F.col("n_enrichi") == F.col("n_distinct_id")))


def duplicated_ids(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            .orderBy(F.col("n").desc(), key).limit(k))


def key_cardinality(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows and duplicated (composite) keys of a dimension."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.lit(name).alias("dimension"), F.lit(", ".join(keys)).alias("cle"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("lignes"),
        F.count_if(F.col("_n") > 1).alias("cles_dupliquees")).withColumn(
        "statut", F.when(F.col("cles_dupliquees") == 0, "unique").otherwise("dupliquée"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    frames = [df.agg(F.count(F.lit(1)).alias("lignes")).select(F.lit(n).alias("table_name"), "lignes")
              for n, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def anomaly_log(df: DataFrame, file: str, key: str, expected: Sequence[str],
                date_parts: Sequence[str] = (), limit_pct: float = 5.0) -> DataFrame:
    """Rule-based anomalies of one dataset: category, level, count, detail.

    All measures come from one aggregate plus one grouped pass for key duplicates.
    """
    from ..functions import dates as dt

    spark = df.sparkSession
    n = F.count(F.lit(1))
    missing = sorted(set(expected) - set(df.columns))
    schema = "categorie string, niveau string, detail string, nb bigint, pct double"
    fixed = [("COLONNE_MANQUANTE", "ERROR", c, 1, None) for c in missing]
    parts: list[DataFrame] = []
    if fixed:
        parts.append(spark.createDataFrame(fixed, schema))

    measures = {"": n}
    for c in df.columns:
        measures[c] = n - F.count(quoted(c))
    wide = df.agg(*[m.alias(f"m{i}") for i, m in enumerate(measures.values())])
    total = F.col("m0")
    structs = [F.struct(F.lit("DONNEES").alias("categorie"), F.lit("ERROR").alias("niveau"),
                        F.lit("vide").alias("detail"), F.lit(0).cast("bigint").alias("nb"),
                        F.lit(None).cast("double").alias("pct"),
                        (total == 0).alias("keep"))]
    for i, c in enumerate(list(measures)[1:], 1):
        nulls = F.col(f"m{i}")
        pct = F.try_divide(nulls * 100.0, total)
        if c == key:
            structs.append(F.struct(
                F.lit("VALEURS_MANQUANTES").alias("categorie"), F.lit("WARNING").alias("niveau"),
                F.lit(f"clé {c}").alias("detail"), nulls.alias("nb"), pct.alias("pct"),
                F.coalesce(nulls > 0, F.lit(False)).alias("keep")))
        structs.append(F.struct(
            F.lit("VALEURS_MANQUANTES").alias("categorie"), F.lit("WARNING").alias("niveau"),
            F.lit(f"colonne {c}").alias("detail"), nulls.alias("nb"), pct.alias("pct"),
            F.coalesce((nulls > 0) & (pct >= limit_pct), F.lit(False)).alias("keep")))
    parts.append(wide.select(F.explode(F.array(*structs)).alias("a")).select("a.*")
                 .where("keep").drop("keep"))
    if key in df.columns:
        dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("nb"))
        parts.append(dup.where(F.col("nb") > 0).select(
            F.lit("DOUBLONS").alias("categorie"), F.lit("WARNING").alias("niveau"),
            F.lit(f"clé {key}").alias("detail"), "nb", F.lit(None).cast("double").alias("pct")))
    if date_parts and set(date_parts) <= set(df.columns):
        bad = df.agg(F.count_if(dt.date_from_parts(*[quoted(c) for c in date_parts]).isNull())
                     .alias("nb"))
        parts.append(bad.where(F.col("nb") > 0).select(
            F.lit("DATE").alias("categorie"), F.lit("WARNING").alias("niveau"),
            F.lit("dates invalides").alias("detail"), "nb", F.lit(None).cast("double").alias("pct")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(file).alias("fichier"), "categorie", "niveau", "detail", "nb", "pct")


def anomaly_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("niveau").agg(F.count(F.lit(1)).alias("nb_anomalies"))


def landing_gaps(landed: DataFrame, expected: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Expected files that did not land, with similarly named files that did.

    `landed` has (nom); `expected` lists (source, file name, pattern).  A variant is
    a landed name that contains the pattern once normalised.  One aggregate over the
    names answers for all expected files.
    """
    from ..functions.text import normalised

    nom = F.col("nom")
    aggs = []
    for i, (_, name, pattern) in enumerate(expected):
        near = normalised(nom).contains(pattern)
        aggs += [F.count_if(nom == name).alias(f"e{i}"), F.count_if(near).alias(f"v{i}"),
                 F.min(F.when(near, nom)).alias(f"x{i}")]
    rows = landed.agg(*aggs).select(F.explode(F.array(*[
        F.struct(F.lit(source).alias("source"), F.lit(name).alias("attendu"),
                 F.col(f"e{i}").alias("presents"), F.col(f"v{i}").alias("nb_variantes"),
                 F.col(f"x{i}").alias("exemple_variante"))
        for i, (source, name, _) in enumerate(expected)])).alias("r")).select("r.*")
    near = F.col("nb_variantes") > 0
    return rows.where(F.col("presents") == 0).select(
        "source", "attendu",
        F.when(near, "NOM_FICHIER").otherwise("FICHIER_MANQUANT").alias("categorie"),
        F.when(near, "WARNING").otherwise("ERROR").alias("niveau"),
        "nb_variantes", "exemple_variante")


def multi_date_accidents(df: DataFrame, key: str, day: str) -> DataFrame:
    """Keys that span several dates: min differs from max."""
    return (df.groupBy(key).agg(F.min(day).alias("premiere"), F.max(day).alias("derniere"))
            .where(F.col("premiere") < F.col("derniere")))


def assert_single_date(df: DataFrame, key: str, day: str) -> DataFrame:
    """Return the frame, or raise when a key spans several dates."""
    if not multi_date_accidents(df, key, day).isEmpty():
        raise ValueError(f"{key} spans several values of {day}")
    return df


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and share per class with the minority ratio and its reading."""
    from ..functions.labels import imbalance_label

    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    alls = df.where(F.col(label).isNotNull()).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col(label) == 1).alias("_pos"),
        F.count_if(F.col(label) == 0).alias("_neg")).withColumn("_j", F.lit(1))
    ratio = F.try_divide(F.col("_pos").cast("double"), F.col("_neg"))
    return counts.withColumn("_j", F.lit(1)).join(alls, "_j").select(
        label, "n", (F.col("n") * 100.0 / F.col("_all")).alias("pct"),
        ratio.alias("ratio"), imbalance_label(ratio).alias("desequilibre"))


def split_report(train: DataFrame, test: DataFrame) -> DataFrame:
    """Feature types, distinct values, moments and gaps on both sides of a split."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        numbers = numeric_columns(df)
        rows = unpivot_row(df, {c: {
            f"mean_{tag}": F.avg(c) if c in numbers else F.lit(None).cast("double"),
            f"std_{tag}": F.stddev_samp(c) if c in numbers else F.lit(None).cast("double"),
            f"pct_na_{tag}": F.avg(F.col(c).isNull().cast("int")) * 100} for c in df.columns})
        uniques = value_counts(df, df.columns).groupBy("colonne").agg(
            F.count(F.lit(1)).alias(f"n_unique_{tag}"))
        return rows.join(uniques, "colonne", "left").na.fill({f"n_unique_{tag}": 0})

    kinds = F.create_map(*[F.lit(x) for f in train.schema for x in (f.name, type_class(f.dataType))])
    both = side(train, "train").join(side(test, "test"), "colonne", "left")
    return both.select(
        F.col("colonne").alias("feature"), F.element_at(kinds, F.col("colonne")).alias("dtype"),
        "n_unique_train", "n_unique_test", "mean_train", "std_train", "pct_na_train", "pct_na_test")
