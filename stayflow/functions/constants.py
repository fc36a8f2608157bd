"""Values that carry meaning: buckets, bins, priorities, thresholds and special tokens."""

# --- fixed values: the data model that this engine shares with its sources ---
CLINICAL_EDGES: dict[str, list[float]] = {
    "VITAL//hr": [0, 50, 60, 80, 100, 120, 150, 200],
    "VITAL//sbp": [0, 70, 90, 110, 130, 150, 180, 250],
    "VITAL//dbp": [0, 40, 50, 60, 70, 80, 100, 140],
    "VITAL//mbp": [0, 50, 60, 65, 75, 90, 110, 150],
    "VITAL//resp_rate": [0, 8, 12, 16, 20, 25, 30, 40],
    "VITAL//spo2": [0, 70, 80, 88, 92, 95, 98, 100],
    "VITAL//temp_c": [33, 35, 36, 36.5, 37.5, 38, 39, 42],
    "LAB_RESULT//potassium": [0, 2.5, 3.0, 3.5, 4.0, 5.0, 5.5, 6.0, 7.0, 10],
    "LAB_RESULT//sodium": [0, 120, 125, 130, 135, 140, 145, 150, 155, 180],
    "LAB_RESULT//glucose": [0, 40, 60, 70, 100, 140, 200, 300, 500, 1000],
    "LAB_RESULT//creatinine": [0, 0.4, 0.7, 1.0, 1.3, 1.8, 2.5, 4.0, 8.0, 20],
    "LAB_RESULT//lactate": [0, 0.5, 1.0, 1.5, 2.0, 4.0, 6.0, 10, 20],
    "LAB_RESULT//hemoglobin": [0, 5, 7, 8, 10, 12, 14, 16, 20],
    "LAB_RESULT//platelets": [0, 20, 50, 100, 150, 250, 400, 600, 1000],
    "LAB_RESULT//wbc": [0, 1, 4, 7, 11, 15, 20, 30, 50],
    "LAB_RESULT//troponin_t": [0, 0.01, 0.03, 0.05, 0.1, 0.5, 1.0, 5.0, 50],
    "LAB_RESULT//inr": [0, 0.8, 1.0, 1.2, 1.5, 2.0, 3.0, 5.0, 10],
    "LAB_RESULT//ph": [6.8, 7.0, 7.15, 7.25, 7.35, 7.45, 7.55, 7.65],
    "LAB_RESULT//pco2": [0, 20, 30, 35, 40, 45, 50, 60, 80, 120],
    "LAB_RESULT//bicarbonate": [0, 10, 15, 18, 22, 26, 30, 35, 50],
}
#: Order of modalities at one time; every other modality has 2.
PRIORITY: dict[str, float] = {"DEMO": 0, "ADMIT": 0, "ICD_POA": 1, "CLOCK": 1, "ECG": 2.5, "LABEL": 3, "DISCH": 4, "ICD": 5, "DRG": 5}
DEFAULT_PRIORITY = 2.0
THRESHOLDS: dict[str, tuple[int, int]] = {
    "labs": (1000, 100),
    "vitals": (500, 50),
    "medications": (200, 50),
    "assessments": (200, 50),
    "procedures": (100, 20),
    "diagnoses": (50, 10),
}
WHITELIST = (
    "LAB_RESULT//troponin_t",
    "LAB_RESULT//troponin_i",
    "LAB_RESULT//bnp",
    "LAB_RESULT//procalcitonin",
    "LAB_RESULT//lactate",
    "LAB_RESULT//d_dimer",
    "RESP//IMV",
    "CRRT//cvvh",
    "ECMO//ECMO",
    "CODE_STATUS//DNR",
    "POSITION//prone",
)
CLOCK_HOURS = 4
GAP_EDGES = [1, 5, 15, 30, 60, 120, 240, 480]
HORIZON_CLOCKS = {8: 2, 24: 6, 48: 12}
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[BOS]", "[EOS]", "[SEP]", "[CONT]"]
LOSS_PREFIXES = ("LABEL//", "DISCH//", "ICD//", "PROC//", "DRG//")
SEVERITY = {"Room Air": 0, "Nasal Cannula": 1, "Face Mask": 1, "High Flow NC": 2, "CPAP": 2, "NIPPV": 3, "IMV": 4}
ECG_ROUTES: dict[str, tuple[str, ...] | None] = {"no_ecg": (), "fusion_class": ("ECG//Class", "ECG//Prototype/1D", "ECG//Similarity/1D"), "all_branches": None}
# --- end of the fixed values ---

#: Modality of a source's codes -> family of its profiling thresholds.
FAMILIES = {"VITAL": "vitals", "LAB_RESULT": "labs", "MED_CONT": "medications", "MED_BOLUS": "medications", "ASSESS": "assessments", "PROC": "procedures", "ICD": "diagnoses"}
