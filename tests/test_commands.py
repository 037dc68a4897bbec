import json

import pytest

from veridat.__main__ import main
from veridat.sources.load import Store


def test_commands_from_file_to_results(spark, tmp_path, capsys):
    store, csv, rules = str(tmp_path / "store"), tmp_path / "c.csv", tmp_path / "rules.json"
    csv.write_text("id,city\n1,Boston\n2,\n")
    rules.write_text(json.dumps([{"definition": {"executable_rule": {"type": "not_null"}}, "column": "city"}, {"definition": {"executable_rule": {"type": "primary_key_unique", "parameters": {"column": "id"}}}}]))
    main([store, "register", "customers", "--file", str(csv), "--key", "id"])
    main([store, "load", "customers"])
    assert json.loads(capsys.readouterr().out)["rows_inserted"] == 2
    main([store, "load", "customers"])
    assert json.loads(capsys.readouterr().out)["rows_updated"] == 2
    main([store, "profile", "customers"])
    assert [p["column_name"] for p in json.loads(capsys.readouterr().out)] == ["id", "city"]
    main([store, "evaluate", "customers", "--rules", str(rules)])
    assert [json.loads(x)["status"] for x in capsys.readouterr().out.split("\n")[:2]] == ["FAIL", "PASS"]
    main([store, "evaluate", "customers", "--rules", str(rules)])
    tables = Store(spark, store)
    assert sorted(r.result_id for r in tables.read("dq_result").collect()) == [1, 2, 3, 4]
    assert [(r.result_id, r.source_row_identifier) for r in tables.read("dq_failed_record").orderBy("result_id").collect()] == [(1, "2"), (3, "2")]
    assert tables.read("control_load_run").count() == 2 and tables.read("control_profile").count() == 2
    main([store, "pipeline", "customers"])
    made = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert len(made["new_rules"]) >= 2
    main([store, "approve", "customers", "--rule", str(made["new_rules"][0]), "--by", "ann"])
    main([store, "status", "customers", "--rule", str(made["new_rules"][1]), "--to", "rejected", "--by", "ann"])
    main([store, "rules", "customers"])
    assert [json.loads(x)["status"] for x in capsys.readouterr().out.strip().split("\n")][:2] == ["approved", "rejected"]
    main([store, "propose", "customers"])
    assert json.loads(capsys.readouterr().out) == []
    main([store, "evaluate", "customers"])
    assert len(capsys.readouterr().out.strip().split("\n")) == 1
    main([store, "remediate", "customers"])
    main([store, "decide", "customers", "--to", "approved", "--by", "ann"])
    main([store, "remediations", "customers"])
    capsys.readouterr()
    main([store, "apply", "customers", "--by", "ann"])
    assert json.loads(capsys.readouterr().out)["changes"] == 0
    main([store, "runs", "customers"])
    assert {json.loads(x)["kind"] for x in capsys.readouterr().out.strip().split("\n")} == {"stewardship", "remediation"}
    main([store, "compact", "dq_result"])
    with pytest.raises(SystemExit):
        main([store, "load", "absent"])


def test_fixed_width_by_command(spark, tmp_path, capsys):
    store, lines, parser = str(tmp_path / "store"), tmp_path / "c.txt", tmp_path / "parser.csv"
    lines.write_text("01Boston    \n02Miami     \n")
    parser.write_text("column_name,start_position,field_length,sequence_number\nid,1,2,1\ncity,3,10,2\n")
    main([store, "register", "towns", "--file", str(lines), "--key", "id", "--parser", str(parser)])
    main([store, "load", "towns"])
    assert json.loads(capsys.readouterr().out)["rows_inserted"] == 2
    assert [(r.id, r.city) for r in Store(spark, store).read("towns").orderBy("id").collect()] == [("01", "Boston"), ("02", "Miami")]
