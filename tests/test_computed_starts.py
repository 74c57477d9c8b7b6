"""The special case whose pointers count records one too far: named by the rules, and computed from the label."""

from orrerylake.jobs import archive, registry
from orrerylake.operators import special_cases

from .conftest import SF


def test_case_is_in_the_query(spark):
    rows = registry.QUERIES["m18_special_cases"](spark, SF).collect()
    assert {r.p_partkey % 28 for r in rows if r.value == "computed"} == {25} and len(rows) == len({r.p_partkey for r in rows})


def test_starts(spark, tmp_path):
    (tmp_path / "p.img").write_bytes(bytes(1000))
    wanted = {"1359362955.9": 400, "1359362956": 300, "1360000000.5": 300, "1363539029": 300, "1363539030": 400, '"UNK"': 400}
    for k, clock in enumerate(wanted):
        label = f"PDS_VERSION_ID = PDS3\nDATA_SET_ID = \"CO-E/V/J-ISSNA/ISSWA-2-EDR-V1.0\"\nRECORD_BYTES = 100\nSPACECRAFT_CLOCK_STOP_COUNT = {clock}\n^IMAGE_HEADER = (\"p.img\", 2)\n^TELEMETRY_TABLE = (\"p.img\", 5)\n"
        (tmp_path / f"p{k}.lbl").write_text(label + "OBJECT = IMAGE_HEADER\nBYTES = 100\nEND_OBJECT\nOBJECT = TELEMETRY_TABLE\nROWS = 1\nROW_BYTES = 10\nEND_OBJECT\nEND\n")
    objects = archive.opened(spark, str(tmp_path), "*.lbl", special_cases.special_cases(spark)).objects
    got = {(r.product[-5], r.name): r.start for r in objects.collect()}
    assert got == {(str(k), name): at for k, start in enumerate(wanted.values()) for name, at in (("IMAGE_HEADER", 100), ("TELEMETRY_TABLE", start))}
