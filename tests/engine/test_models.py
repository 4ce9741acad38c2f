"""Published models with known long-run distributions, the command line, and folders of models."""

import os

import pytest
from pyspark.sql import functions as F

from stillwater import cli
from stillwater.operators import rates, solve, states
from stillwater.plans.solver import Solver, solve_corpus
from stillwater.sources.models import parse_model
from stillwater.streaming.events import tumbling_counts

#: Two published models, and below some of their known long-run probabilities.
MAMMAL = """targets, factors
CycD, (CycD)
Rb_b1, (!Rb_b2&!CycE&!CycA&!CycB)|(!Rb_b2&!CycE&!CycA&CycB&p27_b1)|(!Rb_b2&!CycE&CycA&p27_b1)|(!Rb_b2&CycE&p27_b1)|(Rb_b2)
Rb_b2, (!CycD&Rb_b1&!CycE&!CycA&!CycB)|(!CycD&Rb_b1&!CycE&!CycA&CycB&p27_b1)|(!CycD&Rb_b1&!CycE&CycA&p27_b1)|(!CycD&Rb_b1&CycE&!CycA&p27_b1)|(!CycD&Rb_b1&CycE&CycA&!CycB&p27_b1)
E2F, (!Rb_b1&!CycA&!CycB)|(!Rb_b1&!CycA&CycB&!Cdc20)|(!Rb_b1&CycA&!CycB&p27_b1&!p27_b2&!Skp2)|(!Rb_b1&CycA&!CycB&p27_b1&p27_b2)|(!Rb_b1&CycA&CycB&p27_b1&!p27_b2&!Cdc20&!Skp2)|(!Rb_b1&CycA&CycB&p27_b1&p27_b2&!Cdc20)|(Rb_b1&!Rb_b2&!CycA&!CycB)|(Rb_b1&!Rb_b2&!CycA&CycB&!Cdc20)|(Rb_b1&!Rb_b2&CycA&!CycB&p27_b1&!p27_b2&!Skp2)|(Rb_b1&!Rb_b2&CycA&!CycB&p27_b1&p27_b2)|(Rb_b1&!Rb_b2&CycA&CycB&p27_b1&!p27_b2&!Cdc20&!Skp2)|(Rb_b1&!Rb_b2&CycA&CycB&p27_b1&p27_b2&!Cdc20)
CycE, (!Rb_b1&E2F)|(Rb_b1&!Rb_b2&E2F)
CycA, (!Rb_b1&!E2F&CycA&!Cdc20&!Cdh1)|(!Rb_b1&!E2F&CycA&!Cdc20&Cdh1&!UbcH10)|(!Rb_b1&!E2F&CycA&Cdc20&!UbcH10)|(!Rb_b1&E2F&!Cdc20&!Cdh1)|(!Rb_b1&E2F&!Cdc20&Cdh1&!UbcH10)|(!Rb_b1&E2F&Cdc20&!UbcH10)|(Rb_b1&CycA&!Cdc20&!Cdh1)|(Rb_b1&CycA&!Cdc20&Cdh1&!UbcH10)|(Rb_b1&CycA&Cdc20&!UbcH10)
CycB, (!Cdc20&!Cdh1)|(Cdc20&!Cdh1&!UbcH10)
p27_b1, (!CycE&!CycA&!CycB)|(!CycE&!CycA&CycB&!p27_b2&!Skp2)|(!CycE&!CycA&CycB&p27_b2)|(!CycE&CycA&!CycB&!p27_b1&!p27_b2&!Skp2)|(!CycE&CycA&!CycB&!p27_b1&p27_b2)|(!CycE&CycA&!CycB&p27_b1)|(!CycE&CycA&CycB&!p27_b2&!Skp2)|(!CycE&CycA&CycB&p27_b2)|(CycE&!p27_b2&!Skp2)|(CycE&p27_b2)
p27_b2, (!CycD&!CycE&!CycB&p27_b1)|(!CycD&!CycE&CycB&p27_b1&!Skp2)|(!CycD&CycE&!CycA&!CycB&p27_b1&!p27_b2&!Skp2)|(!CycD&CycE&!CycA&!CycB&p27_b1&p27_b2)|(!CycD&CycE&!CycA&CycB&p27_b1&!Skp2)|(!CycD&CycE&CycA&p27_b1&!Skp2)
Cdc20, (CycB)
Cdh1, (!CycA&!CycB)|(!CycA&CycB&p27_b1)|(CycA&p27_b1&!p27_b2&!Skp2)|(CycA&p27_b1&p27_b2)
UbcH10, (!CycA&!CycB&!Cdc20&!Cdh1)|(!CycA&!CycB&Cdc20&!Cdh1)|(!CycA&!CycB&Cdc20&Cdh1&UbcH10)|(!CycA&CycB&!Cdh1)|(!CycA&CycB&Cdh1&UbcH10)|(CycA&!Cdh1)|(CycA&Cdh1&UbcH10)
Skp2, (!Rb_b1)|(Rb_b1&!Rb_b2)|(Rb_b1&Rb_b2&!Cdh1)
"""
COHEN = """targets, factors
ECMicroenv, (ECMicroenv)
DNAdamage, (DNAdamage)
gf, ((gf|EMTreg)&!Ecadh)
Metastasis, (Migration)
Migration, (EMT&ERK_pthw&AKT2&Invasion&!AKT1&!miRNA&!p63_73)
Invasion, ((TGFb_pthw&EMTreg)|WNT_pthw)
EMT, (!Ecadh&EMTreg)
Apoptosis, (!ERK_pthw&!AKT1&!EMTreg&(miRNA|p63_73|p53))
CCA, ((((p53|p63_73|(TGFb_pthw&Notch_pthw)|AKT2)&!ERK_pthw)|miRNA|EMTreg)&!AKT1)
TGFb_pthw, ((Notch_pthw|ECMicroenv)&!WNT_pthw&!miRNA)
Notch_pthw, (ECMicroenv&!p53&!p63_73&!miRNA)
WNT_pthw, (!Notch_pthw&!EMTreg&!miRNA&!p53&!p63_73&!AKT1&!Ecadh&!WNT_pthw)
p53, ((Notch_pthw|DNAdamage|WNT_pthw)&!AKT1&!AKT2&!p63_73&!EMTreg)
EMTreg, ((Notch_pthw|WNT_pthw|EMTreg)&!miRNA&!p53)
p63_73, (!Notch_pthw&!p53&DNAdamage&!AKT2&!AKT1&!EMTreg)
AKT1, (WNT_pthw&(Notch_pthw|TGFb_pthw|gf|EMTreg)&!miRNA&!p53&!Ecadh)
AKT2, ((TGFb_pthw|gf|Notch_pthw|EMTreg)&EMTreg&!miRNA&!p53)
ERK_pthw, ((TGFb_pthw|Notch_pthw|gf|EMTreg)&!AKT1)
miRNA, ((p53|p63_73)&!AKT2&!EMTreg&!AKT1)
Ecadh, (!EMTreg&!AKT2)
"""
COHEN_START = {"ECMicroenv": 1, "DNAdamage": 1, "Metastasis": 0, "Migration": 0, "Invasion": 0, "EMT": 0, "Apoptosis": 0, "Notch_pthw": 1, "p53": 0}
slow = pytest.mark.skipif(not os.environ.get("STILLWATER_SLOW"), reason="minutes; set STILLWATER_SLOW")


def probabilities(df):
    return {r["state"]: r["p"] for r in df.collect()}


@pytest.fixture(scope="module")
def mammal(spark):
    model = parse_model(MAMMAL)
    start = {"CycE": 0, "CycA": 0, "CycB": 0, "Cdh1": 1, "Rb_b1": 1, "Rb_b2": 1, "p27_b1": 1, "p27_b2": 1}
    s = Solver(spark, model, initial=states.fixed(spark, model, start))
    return s, probabilities(s.final)


def test_thirteen_nodes(mammal):
    """A fixed point and a terminal component of 270 states."""
    s, p = mammal
    assert s.reached.count() == 365 and s.edges.count() == 1191 and len(p) == 271
    assert abs(sum(p.values()) - 1) < 1e-12
    for state, want in {1414: 5.00000000e-01, 4129: 8.15564577e-03, 4131: 9.23763705e-06, 4137: 2.45418759e-05, 4145: 5.78264819e-03, 4147: 1.60878332e-05, 4153: 6.92910955e-03, 4155: 1.64874938e-05, 4193: 5.45880790e-03, 4195: 3.00486805e-05, 4201: 8.21152370e-06, 4203: 1.38403649e-06}.items():
        assert abs(p[state] - want) < 1e-7


def test_thirteen_nodes_in_blocks(mammal, monkeypatch):
    """The component of 270 states solved in blocks of 64 is the same, and balanced."""
    s, p = mammal
    monkeypatch.setattr(solve, "DENSE", 128)
    again = solve.Structure(s.structure.edges, s.structure.states, s.structure.top)
    assert again.kinds[1] == {"one", "large"}
    got = {r["state"]: r["p"] for r in solve.stationary(again).collect()}
    assert max(abs(got[i] / 2 - x) for i, x in p.items() if i != 1414) < 1e-10
    into, out = dict.fromkeys(got, 0.0), dict.fromkeys(got, 0.0)
    for r in again.edges.collect():
        if r["src"] in got and r["src"] != 1414:
            out[r["src"]] += got[r["src"]] * r["rate"]
            into[r["dst"]] += got[r["src"]] * r["rate"]
    assert max(abs(into[i] - out[i]) for i in got) < 1e-12


@slow
def test_twenty_nodes(spark, tmp_path):
    model = parse_model(COHEN)
    start = states.fixed(spark, model, COHEN_START)
    s = Solver(spark, model, initial=start)
    got = probabilities(s.final.where("p > 1e-9"))
    assert set(got) == {206719, 790915, 803203} and max(abs(got[k] - v) for k, v in {206719: 0.66441368, 790915: 0.1986147, 803203: 0.13697163}.items()) < 1.526e-5
    assert s.reached.count() == 64_000 and s.edges.count() == 456_128
    new = rates.uniform(model, up={"DNAdamage": 2.0, "ECMicroenv": 3.0, "TGFb_pthw": 4.0, "Apoptosis": 300.0, "Ecadh": 1000.0}, down={"TGFb_pthw": 933.0, "Apoptosis": 544.0, "Ecadh": 3.0})
    got = probabilities(Solver(spark, model, new, start).final.where("p > 1e-9"))
    assert set(got) == {206719, 790915, 803203} and max(abs(got[k] - v) for k, v in {206719: 0.659006, 790915: 0.202294, 803203: 0.138699}.items()) < 1.526e-5


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    path = tmp_path / "toy.bnet"
    path.write_text("A, A\nC, !A & !D\nD, !A & !C\n")
    assert cli.main(["-f", str(path), "--initial-fixed-list", "A=0,C=0,D=0"]) == 0
    assert capsys.readouterr().out.splitlines() == ["C 0.5", "D 0.5"]
    args = cli.arguments().parse_args(["-f", f"file://{path}", "--trans-rates", "d_C=2", "--symbolic", "-n"])
    for _ in range(2):  # the second run reads what the first one stored
        solver = cli.run(spark, args)
        got = probabilities(solver.final)
        assert all(abs(got[k] - v) < 1e-9 for k, v in {1: 0.5, 2: 0.22916666666666666, 4: 0.2708333333333333}.items())
    assert "solution" in solver.reused
    with pytest.raises(NotImplementedError):
        cli.run(spark, cli.arguments().parse_args(["-f", str(path), "-i", "RANDOM"]))
    with pytest.raises(ValueError):
        cli.run(spark, cli.arguments().parse_args(["-f", str(path), "--initial-fixed-list", "A=7"]))


def test_folder_of_models(spark, tmp_path):
    (tmp_path / "pair.bnet").write_text("targets, factors\nA, B\nB, !A\n")
    (tmp_path / "toy.bnet").write_text("A, A\nC, !A & !D\nD, !A & !C\n")
    got = {name: probabilities(s.final) for name, s in solve_corpus(spark, f"{tmp_path}/*.bnet", {"toy": {"A": 0, "C": 0, "D": 0}})}
    assert set(got) == {"pair", "toy"}
    assert all(abs(got["pair"][i] - 0.25) < 1e-12 for i in range(4)) and all(abs(got["toy"][i] - 0.5) < 1e-12 for i in (2, 4))


def test_windowed_events(spark, tmp_path):
    """A stream of files gives the same windows as the table, once all are closed."""
    table = spark.range(200).select(F.timestamp_seconds(F.col("id") * 97).alias("ts"), F.element_at(F.array(F.lit("view"), F.lit("click")), (F.col("id") % 2 + 1).cast("int")).alias("event_type"))
    table.write.parquet(f"{tmp_path}/in")
    want = {(r["start"], r["event_type"]): r["n"] for r in tumbling_counts(table).collect()}
    stream = tumbling_counts(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("windows").outputMode("update").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("windows").collect()}
    assert got == want and sum(got.values()) == 200
