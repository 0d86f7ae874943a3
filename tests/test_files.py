"""Raw files to curated tables, and the file scans behind them."""

import gzip
import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asphalta.plans import curate
from asphalta.sources import files, streams, tables
from asphalta.sources.snapshots import SnapshotTable, VersionTaken


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))


@pytest.fixture()
def registry(tmp_path):
    root = tmp_path / "registre"
    put(root / "Caract_2023.csv",
        "Num_Acc;jour;mois;an;hrmn;dep;com;lat;long;lum\n1;5;1;2023;09:30;75;75101;48,85;2,35;1\n"
        "2;6;1;2023;10:00;93;93001;48,9;2,4;-1\n1;5;1;2023;09:30;75;75101;48,85;2,35;1\n;;;;;;;;;\n", "latin-1")
    put(root / "carcteristiques-2022.csv", "Accident_Id;dep;lum\n7;75;nan\n8;075;2\n", "latin-1")
    put(root / "caract-2022.csv", " Accident_Id ;dep;lum\n9;075;Été\n", "latin-1")
    put(root / "Lieux_2023.csv", "Num_Acc;voie\n1;B\n1;A\n2;C\n")
    put(root / "usagers-2023.csv", "Num_Acc;grav\n1;3\n2;2\n9;1\n")
    put(root / "vehicules-immatricules-2023.csv", "Id_Accident;x\n1;1\n")
    return str(root)


def test_registry(spark, registry):
    out = curate.curate_registry(spark, registry)
    assert set(out) == {"caracteristiques", "lieux", "usagers", "rapport"}
    acc = {r["Num_Acc"]: r for r in out["caracteristiques"].collect()}
    # A misspelt stem is not recognised; the other 2022 file and Paris rows of 2023 are.
    assert set(acc) == {"1", "9"} and acc["9"]["annee_source"] == 2022 and acc["9"]["com"] is None
    roads = out["lieux"].collect()
    assert [(r["Num_Acc"], r["voie"], r["nb_voies_intersection"], r["intersection"]) for r in roads] == [("1", "A", 2, True)]
    assert sorted(r["Num_Acc"] for r in out["usagers"].collect()) == ["1", "9"]
    report = {r["fichier"]: (r["lignes_avant"], r["lignes_apres"]) for r in out["rapport"].collect()}
    assert report["Caract_2023.csv"][1] == 1


def test_traffic_lines(spark, tmp_path):
    root = tmp_path / "trafic"
    put(root / "2024" / "trafic_2024_w01.txt",
        "iu_ac;t_1h;q;k;dessin\n10;2024-01-01 00:00:00;100;1.5;d\n10;2024-01-01 01:00:00;x;2.5;d\n"
        "10;2024-01-01 02:00:00;300\n10;2024-01-01 03:00:00;1;2;3;4;5\n10;2024-01-01 04:00:00;200;2.0;d\n")
    raw = files.tolerant_lines(spark, str(root), ["iu_ac", "t_1h", "q", "k", "dessin"], header=True)
    assert raw.count() == 4 == len(raw.collect())
    out = curate.curate_traffic(spark, str(root)).collect()
    assert len(out) == 1 and out[0]["fichier_source"] == "trafic_2024_w01.txt"
    assert (out[0]["q_total"], out[0]["nb_heures"], out[0]["q_missing_rate"]) == (800.0, 4, 0.25)


def test_gzip_hidden_behind_csv(spark, tmp_path):
    lines = ["NUM_POSTE;AAAAMMJJ;RR;TN;QRR;VIDE"] + [
        f"75001;202401{d:02d};{d}.5;1;{d % 3};" for d in range(1, 6)] + ["75001;20240101;0;1;9;", "75001;20190101;1;1;1;"]
    put(tmp_path / "m" / "Q_75_RR-T-Vent.csv", gzip.compress("\n".join(lines).encode()))
    out = curate.curate_weather(spark, str(tmp_path / "m"))
    assert "vide" not in out.columns and dict(out.dtypes)["qrr"] == "tinyint" and dict(out.dtypes)["rr"] == "double"
    assert out.count() == 5 and out.where("date_obs = '2024-01-01'").head()["rr"] == 0.0


def test_each_file_by_its_own_header(spark, tmp_path):
    root = tmp_path / "t"
    hour = "2024-01-01 0{}:00:00"
    put(root / "a.txt", "\ufeffiu_ac;t_1h;q;k;dessin;etat_trafic;etat_barre\n" + f"1;{hour.format(1)};10;2;d;e;b\n1;{hour.format(2)};20;4;d;e;b;too;long\n")
    put(root / "b.txt", f"t_1h;iu_ac;k;q\r\n{hour.format(1)};2;3;30\r\n{hour.format(2)};2;5;50\r\n")
    put(root / "c.txt", "iu;quand\n1;2\n")
    raw, left_out = files.read_by_header(spark, str(root), ("iu_ac", "t_1h"))
    assert [f.rsplit("/", 1)[1] for f in left_out] == ["c.txt"]
    assert sorted((r["iu_ac"], r["q"], r["k"]) for r in raw.collect()) == [("1", "10", "2"), ("2", "30", "3"), ("2", "50", "5")]
    out = {r["iu_ac"]: r for r in curate.curate_traffic(spark, str(root)).collect()}
    assert out["1"]["q_total"] == 10 and out["2"]["q_total"] == 80 and out["2"]["k_moyen"] == 4


def test_weather_files_with_other_column_orders(spark, tmp_path):
    put(tmp_path / "m" / "x.csv", gzip.compress("\ufeffNUM_POSTE;AAAAMMJJ;RR;TN\n75;20240101;1.5;2\n75;20240102;0;3\n".encode()))
    put(tmp_path / "m" / "y.csv", "NUM_POSTE;AAAAMMJJ;TN;RR\n75;20240103;-1;4\n")
    out = sorted((str(r["date_obs"]), r["rr"], r["tn"]) for r in curate.curate_weather(spark, str(tmp_path / "m")).collect())
    assert out == [("2024-01-01", 1.5, 2.0), ("2024-01-02", 0.0, 3.0), ("2024-01-03", 4.0, -1.0)]
    put(tmp_path / "o" / "z.csv", "NUM_POSTE;AAAAMMJJ;GLOT\n75;20240101;9\n")
    both = {str(r["date_obs"]): r.asDict() for r in curate.curate_reference_weather(spark, str(tmp_path / "m"), str(tmp_path / "o")).collect()}
    assert len(both) == 3 and both["2024-01-01"]["glot"] == "9" and both["2024-01-02"]["glot"] is None


def test_long_gzip_members_and_plain_files(spark, tmp_path):
    text = "".join(f"line {i}\n" for i in range(200000)).encode()
    put(tmp_path / "x" / "two.csv", gzip.compress(text) + gzip.compress(b"tail\r\nlast"))
    put(tmp_path / "x" / "plain.csv", b"a\nb")
    counts = {r["path"].rsplit("/", 1)[1]: r["count"] for r in
              files.read_sniffed(spark, str(tmp_path / "x")).groupBy("path").count().collect()}
    assert counts == {"two.csv": 200002, "plain.csv": 2}


def test_population(spark):
    data = spark.createDataFrame(
        [(" 75101 ", "ARM", "A", "PTOT", "2023", "100"), ("75101", "ARM", "A", "PTOT", "2023", "100"),
         ("75", "DEP", "A", "PTOT", "2023", "-5"), ("75", "COM", "A", "PTOT", "2023", "7"), ("69", "DEP", "A", "PTOT", "bad", "1")],
        "GEO string, GEO_OBJECT string, FREQ string, POPREF_MEASURE string, TIME_PERIOD string, OBS_VALUE string")
    meta = spark.createDataFrame([("GEO", "75101", "Paris 1er"), ("POPREF_MEASURE", "PTOT", "Population totale")],
                                 "COD_VAR string, COD_MOD string, LIB_MOD string")
    out = {(r["geo"], r["geo_object"]): r for r in curate.curate_population(data, meta).collect()}
    assert set(out) == {("75101", "ARM"), ("75", "DEP")}
    assert out["75101", "ARM"]["geo_lib"] == "Paris 1er" and out["75", "DEP"]["obs_value"] is None
    assert out["75", "DEP"]["geo_lib"] is None


def test_sensors(spark, tmp_path):
    put(tmp_path / "s" / "ref.json", json.dumps([
        {"iu_ac": 1, "libelle": "a", "geo_point_2d": {"lon": 2.3, "lat": 48.8}},
        {"iu_ac": 1, "libelle": "a", "geo_point_2d": {"lon": 2.3, "lat": 48.8}},
        {"iu_ac": 2, "libelle": "b", "geo_point_2d": None}]))
    out = {r["iu_ac"]: (r["lat_wgs84"], r["lon_wgs84"]) for r in curate.curate_sensors(spark, str(tmp_path / "s")).collect()}
    assert out == {1: (48.8, 2.3), 2: (None, None)}


def test_first_available_candidate(spark, tmp_path):
    put(tmp_path / "ok.csv", "a,b\n1,x\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    got = files.read_first_available(spark, [str(tmp_path / "no.csv"), str(tmp_path / "ok.csv")], schema)
    assert [tuple(r) for r in got.collect()] == [(1, "x")]
    assert files.read_first_available(spark, [str(tmp_path / "no.csv")], schema).isEmpty()


def test_archives(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "1\n2\n")
        z.writestr("b.txt", "3")
    frame = spark.createDataFrame([("good.zip", bytearray(buffer.getvalue())), ("bad.zip", bytearray(b"PK junk"))],
                                  "path string, content binary")
    got = sorted(tuple(r) for r in files.expand_archives(frame).select("path", "entree", "statut", "value").na.fill("").collect())
    assert got == [("bad.zip", "", "CORROMPU", ""), ("good.zip", "a.txt", "OK", "1"), ("good.zip", "a.txt", "OK", "2"),
                   ("good.zip", "b.txt", "OK", "3")]


def test_empty_frame_does_not_replace_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3)
    assert tables.replace_table(df, path)
    assert not tables.replace_table(df.where("id < 0"), path)
    assert SnapshotTable(spark, path).read().count() == 3


def test_versions_are_whole_and_taken_once(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "v"))
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.version == 0 and table.write(spark.range(5)) and table.version == 1
    first = table.read()
    assert table.write(table.read().where("id > 1"))  # from itself
    assert (first.count(), table.read().count(), table.read(1).count()) == (5, 3, 5)
    broken = table.read().select(F.when(F.col("id") > 3, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        table.write(broken)
    assert (table.version, table.read().count()) == (2, 3)
    base = table.version  # two writers that start from the same version
    assert table.write(spark.range(7), base=base)
    with pytest.raises(VersionTaken):
        SnapshotTable(spark, str(tmp_path / "v")).write(spark.range(8), base=base)
    assert table.read().count() == 7
    assert table.drop_old(keep=1) == [1, 2] and table.read().count() == 7
    assert len(list((tmp_path / "v" / "data").iterdir())) == 1


def test_table_from_itself(spark, tmp_path):
    name, path = f"asphalta_test_{uuid.uuid4().hex}", str(tmp_path / "t")
    tables.create_table_as(spark, name, spark.range(4), path)
    made = tables.create_table_as(spark, name, spark.table(name).selectExpr("id", "id * 2 AS d"), path)
    assert made.columns == ["id", "d"] and spark.table(name).count() == 4
    with pytest.raises(Exception, match="stop"):
        tables.create_table_as(spark, name, spark.table(name).select(F.raise_error(F.lit("stop")).cast("int").alias("x")), path)
    assert spark.table(name).count() == 4
    spark.sql(f"DROP TABLE {name}")


def test_quoted_separators_are_no_separators(spark, tmp_path):
    lines = ["iu_ac;t_1h;q;k;etat", '2;2024-01-01 01:00:00;1;2;"Rue; nord"', '3;2024-01-01 01:00:00;1;2;"a ""b""; c"', "4;t;1;2;3;4", '5;t;1;2;"open; end', "6;t"]
    put(tmp_path / "q" / "a.txt", "\n".join(lines))
    put(tmp_path / "q" / "b.txt", gzip.compress("\n".join(lines).encode()))
    raw, left_out = files.read_by_header(spark, str(tmp_path / "q"), ("iu_ac", "t_1h"))
    assert not left_out
    for name in ("a.txt", "b.txt"):
        got = {r["iu_ac"]: r["etat"] for r in raw.where(F.col("fichier_source") == name).collect()}
        assert got == {"2": "Rue; nord", "3": 'a "b"; c', "6": None}
    df = spark.createDataFrame([(x,) for x in ("a;b", '"a;b"', '"a;""b;"";c";d', 'a"b;c"', '"";', "")], "v string")
    assert [r[0] for r in df.select(files.field_count(F.col("v"))).collect()] == [2, 1, 2, 2, 2, 1]


def test_streams_hold_pieces_only():
    """A gzip stream far larger than a piece, in several members, read a piece at a time."""
    line = b"0123456789" * 10 + b"\n"
    packed = b"".join(gzip.compress(line * 100_000) for _ in range(3))

    class Counted(io.BytesIO):
        most = 0

        def read(self, n=-1):
            assert 0 < n <= streams.PIECE
            return super().read(n)

    sizes = [len(p) for p in streams.pieces(Counted(packed))]
    assert sum(sizes) == 300_000 * len(line) and max(sizes) <= streams.PIECE
    assert sum(1 for _ in streams.lines_of(Counted(packed))) == 300_000


def test_heads_come_from_tasks(spark, tmp_path):
    put(tmp_path / "h" / "with space.csv", "\ufeffa;b\r\n1;2\n")
    put(tmp_path / "h" / "z.csv", gzip.compress(b"c;d\n3;4"))
    put(tmp_path / "h" / "empty.csv", b"")
    got = {r["path"].rsplit("/", 1)[1]: (r["zipped"], r["header"]) for r in streams.heads(streams.listed(spark, str(tmp_path / "h"))).collect()}
    assert got == {"with space.csv": (False, "a;b"), "z.csv": (True, "c;d")}  # files without content have no head


def test_fallback_when_columns_are_missing(spark):
    spark.range(2).createOrReplaceTempView("asphalta_probe")
    made = tables.table_or_rebuild(spark, "asphalta_probe", ["id", "x"], lambda: spark.range(7).withColumn("x", F.lit(1)))
    assert made.count() == 7
    assert tables.table_or_rebuild(spark, "asphalta_probe", ["id"], lambda: None).count() == 2


def test_classified_lines_look_at_names_once_a_file(spark, registry):
    """Kind and year by a join on the file, none of the name's expressions a line; lines as before."""
    lines = files.classified_lines(spark, registry)
    got = {(r["fichier"], r["type_fichier"], r["annee_source"]): r["n"] for r in lines.groupBy(
        "fichier", "type_fichier", "annee_source").agg(F.count("value").alias("n")).collect()}
    assert {k[2]: sum(n for q, n in got.items() if q[2] == k[2]) for k in got} == {2022: 3 + 2, 2023: 5 + 4 + 4}
    assert lines.columns == ["value", "fichier", "type_fichier", "annee_source"]
    assert "regexp" not in lines._jdf.queryExecution().executedPlan().toString().lower()
