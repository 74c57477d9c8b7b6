"""The archive's known special cases as rows of the rules table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .rules import RULES

#: A condition: column, test, operand; of an interval the operand is its two ends. Columns are the identifiers in lower case, ``name`` of the object, ``file``, ``interchange`` and ``clock``.
Condition = tuple[str, str, str]

#: Which products need what. Stage, field and value, and the cases they hold for; all conditions of a case must hold.
CASES: list[tuple[str, str, str, list[list[Condition]]]] = [
    ("reader", "READER", "spreadsheet", [
        [("data_set_id", "equals", "CO-S-MIMI-4-CHEMS-CALIB-V1.0")],
        [("data_set_id", "equals", "CO-S-MIMI-4-LEMMS-CALIB-V1.0")],
        [("data_set_id", "equals", "CO-S-MIMI-4-INCA-CALIB-V1.0")],
        [("data_set_id", "equals", "CO-E/J/S/SW-MIMI-2-LEMMS-UNCALIB-V1.0")],
        [("data_set_id", "equals", "CO-SSA-RADAR-3-ABDR-SUMMARY-V1.0")],
        [("instrument_host_name", "equals", "CASSINI ORBITER"), ("product_type", "equals", "ANCILLARY"), ("data_set_id", "contains", "CO-S-MIMI-4-")],
        [("instrument_id", "equals", "CHEMIN"), ("name", "contains", "SPREADSHEET")],
        [("data_set_id", "contains", "MSL-M-SAM-"), ("product_id", "contains", "QMS"), ("name", "contains", "TABLE")],
        [("data_set_id", "equals", "MSL-M-ROVER-6-RDR-PLACES-V1.0"), ("name", "equals", "SPREADSHEET")],
    ]),
    ("reader", "READER", "white space", [
        [("instrument_name", "equals", "ROSETTA PLASMA CONSORTIUM - MUTUAL IMPEDANCE PROBE"), ("name", "contains", "SPECTRUM_TABLE")],
        [("data_set_id", "equals", "ODY-M-GRS-5-ELEMENTS-V1.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "VG1-J-LECP-4-SUMM-SECTOR-15MIN-V1.1"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "VG2-U-LECP-4-RDR-STEP-12.8MIN-V1.0"), ("interchange", "equals", "ASCII"), ("name", "equals", "TABLE")],
        [("instrument_host_name", "equals", "LUNAR RECONNAISSANCE ORBITER"), ("instrument_name", "equals", "RADIO SCIENCE SUBSYSTEM"), ("name", "equals", "WEAREC_TABLE")],
    ]),
    ("reader", "READER", "without nuls", [
        [("spacecraft_name", "equals", "MAGELLAN"), ("name", "equals", "TABLE"), ("note", "starts", "Geometry")],
        [("data_set_id", "equals", "GO-J-NIMS-4-ADR-SL9IMPACT-V1.0"), ("name", "equals", "TABLE"), ("product_id", "contains", "CAL_DATA.TAB")],
        [("data_set_id", "equals", "GO-J-NIMS-4-ADR-SL9IMPACT-V1.0"), ("name", "equals", "TABLE"), ("product_id", "contains", "G_DATA.TAB")],
        [("data_set_id", "equals", "GO-J-NIMS-4-ADR-SL9IMPACT-V1.0"), ("name", "equals", "TABLE"), ("product_id", "contains", "R_DATA.TAB")],
    ]),
    ("reader", "READER", "records by bytes", [
        [("data_set_id", "starts", "MGN-V-RSS-5-OCC-PROF"), ("name", "equals", "TABLE")],
    ]),
    ("reader", "READER", "delimited", [
        [("instrument_id", "equals", "DLRE"), ("product_type", "equals", "GCP"), ("name", "equals", "TABLE")],
        [("instrument_id", "equals", "DLRE"), ("product_type", "equals", "PCP"), ("name", "equals", "TABLE")],
        [("instrument_id", "equals", "DLRE"), ("product_type", "equals", "PRP"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "GO-J-PWS-5-DDR-PLASMA-DENSITY-FULL-V1.0"), ("name", "equals", "SPREADSHEET")],
        [("instrument_id", "equals", "CRISM"), ("product_type", "equals", "ANCILLARY"), ("product_id", "contains", "OBS"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "IHW-C-IRFCURV-3-EDR-HALLEY-V2.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "VL2-M-SEIS-5-RDR-V1.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "VL2-M-SEIS-5-RDR-V1.0"), ("name", "equals", "SPREADSHEET")],
        [("data_set_id", "contains", "MEX-M-ASPERA3-2-EDR-IMA"), ("name", "equals", "SPREADSHEET")],
        [("data_set_id", "regex", "^MER[12]-M-RSS-1-EDR-V1.0"), ("product_type", "equals", "UHFD"), ("name", "equals", "SPREADSHEET")],
        [("data_set_id", "equals", "LRO-L-MRFLRO-1-PDR-V1.0"), ("product_id", "contains", "HK_"), ("name", "equals", "SPREADSHEET")],
        [("instrument_host_name", "equals", "MARS SCIENCE LABORATORY"), ("instrument_id", "equals", "REMS"), ("name", "contains", "TABLE"), ("product_id", "contains", "SP_____")],
        [("instrument_host_name", "equals", "LUNAR PROSPECTOR"), ("product_id", "equals", "OUTAGES"), ("name", "equals", "TABLE")],
    ]),
    ("reader", "READER", "filled headers", [
        [("data_set_id", "contains", "MRO-M-MCS-5-DDR"), ("data_set_id", "lacks", "V1.0"), ("name", "equals", "TABLE")],
    ]),
    ("reader", "READER", "added breaks", [
        [("data_set_id", "equals", "IHW-C-PPFLX-3-RDR-HALLEY-V1.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "IHW-C-PPOL-3-RDR-HALLEY-V1.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "IHW-C-PPSTOKE-3-RDR-HALLEY-V1.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "IHW-C-PPMAG-3-RDR-HALLEY-V1.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "IHW-C-MSNRDR-3-RDR-HALLEY-ETA-AQUAR-V1.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "IHW-C-MSNRDR-3-RDR-HALLEY-ORIONID-V1.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "IHW-C-MSNVIS-3-RDR-HALLEY-ETA-AQUAR-V1.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "IHW-C-MSNVIS-3-RDR-HALLEY-ORIONID-V1.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "IHW-C-IRFTAB-3-RDR-HALLEY-V1.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "IHW-C-IRPOL-3-RDR-HALLEY-V1.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "equals", "IHW-C-IRPHOT-3-RDR-HALLEY-V1.0"), ("name", "equals", "TABLE")],
        [("data_set_id", "contains", "ICE-C-"), ("data_set_id", "contains", "-3-RDR-"), ("file", "contains", "TRAJ_ICE"), ("name", "equals", "TABLE")],
    ]),
    ("reader", "READER", "after marker", [
        [("data_set_id", "equals", "VG1-S-LECP-3-RDR-STEP-6MIN-V1.0"), ("name", "equals", "SPREADSHEET")],
    ]),
    ("reader", "READER", "sections", [
        [("data_set_id", "equals", "PHX-M-MECA-4-NIRDR-V1.0"), ("instrument_id", "equals", "MECA_AFM"), ("name", "contains", "TABLE")],
        [("instrument_host_name", "equals", "MARS EXPRESS"), ("instrument_id", "equals", "MRS"), ("product_id", "contains", "ODF"), ("product_id", "contains", "L1B"), ("name", "contains", "TABLE")],
    ]),
    ("reader", "READER", "null spellings", [
        [("instrument_host_name", "equals", "MARS SCIENCE LABORATORY"), ("instrument_id", "equals", "REMS"), ("name", "equals", "REMS_SCIENCE_TABLE"), ("data_set_id", "contains", "RDR")],
    ]),
    ("block", "ROWS", "FILE_RECORDS", [
        [("data_set_id", "equals", "PVO-V-OIMS-4-IONDENSITY-12S-V1.0"), ("name", "equals", "TABLE")],
    ]),
    ("block", "ROW_BYTES", "145", [
        [("data_set_id", "contains", "VG2-N-MAG-4-RDR-HGCOORDS"), ("standard_data_product_id", "equals", "ASCII DATA"), ("name", "equals", "TABLE")],
    ]),
    ("block", "ROW_BYTES", "64", [
        [("data_set_id", "equals", "VG2-SS-PLS-3-RDR-FINE-RES-V1.0"), ("name", "equals", "TABLE"), ("row_bytes", "equals", "57")],
    ]),
    ("block", "BLOCK", "IMAGE", [
        [("name", "equals", "XDR_DOCUMENT")],
    ]),
    ("start byte", "START_BYTE", "64", [
        [("instrument_id", "equals", "CRAT"), ("product_type", "equals", "EDR"), ("name", "equals", "TABLE_1")],
    ]),
    ("start byte", "START_BYTE", "computed", [
        [("data_set_id", "equals", "CO-E/V/J-ISSNA/ISSWA-2-EDR-V1.0"), ("clock", "interval", "1359362956 1363539029")],
    ]),
    ("kind", "KIND", "image", [
        [("data_set_id", "contains", "SLN-L-SP"), ("name", "contains", "SPECTRUM")],
    ]),
    ("reader", "SKIP_LINES", "4", [
        [("data_set_id", "contains", "CO-S-MIMI-4-"), ("file", "contains", "FULL")],
    ]),
    ("reader", "SKIP_LINES", "0", [
        [("data_set_id", "equals", "CO-SSA-RADAR-3-ABDR-SUMMARY-V1.0")],
    ]),
    ("reader", "SKIP_LINES", "1", [
        [("data_set_id", "equals", "CO-E/J/S/SW-MIMI-2-LEMMS-UNCALIB-V1.0")],
    ]),
    ("reader", "SKIP_LINES", "7", [
        [("data_set_id", "contains", "CO-S-MIMI-4-")],
    ]),
]


def special_cases(spark: SparkSession) -> DataFrame:
    """RULES with a row for each condition; the conditions of a case share its priority, and earlier cases go first."""
    every = [(stage, field, value, case) for stage, field, value, cases in CASES for case in cases]

    def operands(test: str, operand: str) -> tuple[str | None, float | None, float | None]:
        return (None, *map(float, operand.split())) if test == "interval" else (operand, None, None)

    rows = [(priority, stage, column, test, *operands(test, operand), field, value) for priority, (stage, field, value, case) in enumerate(every, 1) for column, test, operand in case]
    return spark.createDataFrame(rows, RULES)
