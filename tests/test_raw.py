"""From raw files to the enriched fact on a handful of rows."""

import json

from asphalta.plans.raw import RawDomain, RawFolders
from asphalta.plans.star import Star


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_raw_files_to_enriched_fact(spark, tmp_path):
    reg = tmp_path / "registre"
    put(reg / "Caractéristiques-2024.csv", "Num_Acc;jour;mois;an;hrmn;lum;dep;com;atm;col;lat;long\n"
        "1;2;1;2024;10:30;1;75;75101;1;2;48,85;2,35\n2;3;1;2024;11:00;5;93;93001;1;2;48,9;2,4\n3;x;1;2024;11:00;5;75;75102;-1;2;;\n", "latin-1")
    put(reg / "usagers-2024.csv", "Num_Acc;num_veh;place;catu;grav\n1;A01;1;1;3\n1;A01;1;1;3\n1; B01;2;3;-1\n2;A01;1;1;2\n3;A01;1;1;4\n", "latin-1")
    put(reg / "vehicules-2024.csv", "Num_Acc;num_veh;catv\n1;A01;33\n1;A01;7\n1;B01;\n", "latin-1")
    put(tmp_path / "t" / "trafic_2024-01.txt", "iu_ac;t_1h;q;k\n7;2024-01-01 00:00:00;10;2\n7;2024-01-01 01:00:00;;4\n7;2024-01-01 02:00:00;30;x\n7;2024-01-01 03:00:00;20;1\n")
    put(tmp_path / "m" / "Q_75.csv", "NUM_POSTE;AAAAMMJJ;RR;TN;TX;TM\n75;20240102;1.5;2;8;5\n75;20240103;0;1;7;4\n")
    data = put(tmp_path / "pop.csv", "GEO;GEO_OBJECT;FREQ;POPREF_MEASURE;TIME_PERIOD;OBS_VALUE\n75101;ARM;A;PTOT;2022;5\n75101;ARM;A;PTOT;2023;9\n75101;ARM;A;PMUN;2023;8\n")
    labels = put(tmp_path / "meta.csv", "COD_VAR;COD_MOD;LIB_MOD\nPOPREF_MEASURE;PTOT;Population totale\nPOPREF_MEASURE;PMUN;Population municipale\n")
    put(tmp_path / "s" / "ref.json", json.dumps([{"iu_ac": 7, "libelle": "a", "geo_point_2d": {"lon": 2.35, "lat": 48.85}}]))
    folders = RawFolders(str(reg), str(tmp_path / "t"), str(tmp_path / "m"), data, labels, str(tmp_path / "s"))
    rows = {(r["num_acc"], r["id_usager"]): r for r in Star(RawDomain(spark, folders)).enriched().collect()}
    assert set(rows) == {("1", "1_A01_1"), ("1", "1_B01_2"), ("3", "3_A01_1")}  # the repeated row counts once, 93 is left out
    first, second, third = (rows[k] for k in sorted(rows))
    assert (first["aaaammjj"], first["iu_ac"], first["grav"], first["catv"], first["annee_semaine"]) == ("20240102", "7", 3, 7, "2024-01")
    assert (first["q_total"], first["meteo_precipitations"], first["population"], first["population_annee"]) == (80.0, 1.5, 9.0, 2023)  # the gap is filled by the median
    assert second["grav"] is None and second["catv"] is None
    assert third["aaaammjj"] is None and third["atm"] is None and third["q_total"] is None and third["geo_key"] is None
