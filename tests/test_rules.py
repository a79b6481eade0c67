import pytest
from pyspark.sql import functions as F

from opsignal import shipped_rules
from opsignal.operators import rules

NAMES = ["selection", "selection_b", "filter_x", "_hidden"]


@pytest.mark.parametrize("text, tree", [
    ("selection", "selection"),
    ("selection and not filter_x", ("and", "selection", ("not", "filter_x"))),
    ("selection or selection_b and filter_x", ("or", "selection", ("and", "selection_b", "filter_x"))),
    ("(selection or selection_b) and not (filter_x)", ("and", ("or", "selection", "selection_b"), ("not", "filter_x"))),
    ("1 of selection*", ("or", "selection", "selection_b")),
    ("all of them and not 1 of filter_*", ("and", ("and", "selection", "selection_b", "filter_x"), ("not", "filter_x"))),
    ("NOT selection", ("not", "selection")),
])
def test_conditions(text, tree):
    assert rules.parse_condition(text, NAMES) == tree


@pytest.mark.parametrize("text", ["", "selection and", "(selection", "selection filter_x", "other", "1 of other*", "selection & filter_x", "1 of"])
def test_wrong_conditions(text):
    with pytest.raises(ValueError):
        rules.parse_condition(text, NAMES)


def test_every_shipped_rule_by_its_selections(spark):
    """A record that each rule's own detection must meet, and one that it mustn't."""
    yes = {
        "c2-callback": {"Image": "/usr/bin/NC", "DestPort": "4444"}, "container-shell": {"Image": "/bin/sh", "ContainerName": "c"},
        "crypto-miner": {"Image": "/x/xmrig", "CommandLine": "a -o stratum b"}, "privilege-escalation": {"Image": "/usr/sbin/capsh", "CommandLine": "cap_setuid"},
        "windows_defender_disabled": {"EventID": "4689", "ProcessName": "c:\\MSMPENG.exe"}, "windows_audit_policy_changed": {"EventID": "4719"},
        "hyperv_vm_unexpected_shutdown": {"EventID": "18570"}, "hyperv_migration_failure": {"EventID": "21502"},
        "windows_psexec": {"EventID": "7045", "ServiceName": "xPSEXESVCx"}, "windows_wmi_remote": {"ParentProcessName": "c:\\wmiprvse.exe", "Image": "c:\\cmd.exe"},
        "windows_scheduled_task_creation": {"EventID": "4698", "SubjectUserName": "bob"}, "windows_new_service": {"EventID": "7045", "ServiceName": "new"},
    }
    no = {
        "c2-callback": {"Image": "/usr/bin/nc", "DestPort": "80"}, "container-shell": {"Image": "/bin/sh"},
        "windows_scheduled_task_creation": {"EventID": "4698", "SubjectUserName": "HOST$"}, "windows_new_service": {"EventID": "7045", "ServiceName": "WINDEFEND"},
    }
    df = spark.createDataFrame([(f, "yes", m) for f, m in yes.items()] + [(f, "no", m) for f, m in no.items()], "rule string, want string, fields map<string,string>")
    assert set(yes) == {r["id"] for r in shipped_rules.RULES}
    for r in shipped_rules.RULES:
        where = rules.detection_column(r["detection"], lambda f: F.try_element_at("fields", F.lit(shipped_rules.FIELD_NAMES.get(f, f))))
        got = {x["want"]: x["hit"] for x in df.filter(F.col("rule") == r["id"]).select("want", where.alias("hit")).collect()}
        assert got["yes"] is True and not got.get("no", False), r["id"]


def test_records_are_held_against_rules_of_their_source(spark):
    rows = [(1, {"log.source": "windows-system"}, {"EventID": "4719"}, "", ""), (2, {"log.source": "windows-security"}, {"EventID": "4719"}, None, None), (3, {}, None, "Terminal shell in container", "runtime-security")]
    df = spark.createDataFrame(rows, "id long, attributes map<string,string>, fields map<string,string>, line string, event_class string")
    got = rules.match_shipped(df, shipped_rules.RULES, shipped_rules.LOG_SOURCES, shipped_rules.FIELD_NAMES, ["id"])
    assert sorted((r["id"], r["rule_id"], r["mitre"]) for r in got.collect()) == [(2, "windows_audit_policy_changed", "attack.t1562.002"), (3, "container-shell", "attack.t1059.004")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    with pytest.raises(ValueError):
        rules.match_shipped(df, [{**shipped_rules.RULES[5], "logsource": {"product": "macos"}}], shipped_rules.LOG_SOURCES, {}, ["id"])
