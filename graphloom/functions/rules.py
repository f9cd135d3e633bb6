"""Labels, rules and word lists that results must agree on. All of them are defaults of parameters."""

from __future__ import annotations

# Evidence tiers
TIERS = ((0, "hypothesis"), (1, "in vitro"), (2, "animal"), (3, "retrospective human"), (4, "phase I/II"), (5, "randomized"))

NODE_LABELS = ("Paper", "Gene", "Drug", "Pathway", "Biomarker", "Treatment", "Outcome", "CellType", "CellState", "DeliveryModifier", "Trial", "Disease", "EvidenceLevel")
RELATION_TYPES = ("MENTIONS", "TARGETS", "ASSOCIATED_WITH", "PREDICTS", "IMPROVES", "WORSENS", "ACTIVATES", "INHIBITS", "ENHANCES_DELIVERY_OF", "SYNERGIZES_WITH", "TRANSITIONS_TO", "MODULATES_POLARIZATION_OF", "HAS_EVIDENCE")
#: Key property of a node label; all others: name
NODE_KEYS = {"Paper": "pmid", "Gene": "symbol", "Trial": "nct_id", "EvidenceLevel": "tier"}

_ENDS = ("Gene", "Drug", "Pathway", "Biomarker", "Treatment", "Outcome", "CellType", "CellState", "DeliveryModifier", "Trial", "Disease")
#: Relation -> pairs of head and tail label
ALLOWED_EDGES = {
    "MENTIONS": tuple(("Paper", x) for x in _ENDS),
    "TARGETS": (("Drug", "Gene"), ("Treatment", "Gene"), ("Drug", "Pathway"), ("Treatment", "Pathway")),
    "ASSOCIATED_WITH": (("Gene", "Disease"), ("Gene", "Outcome"), ("Biomarker", "Outcome"), ("Biomarker", "Disease"), ("CellType", "Outcome"), ("CellState", "Outcome"), ("Pathway", "Disease"), ("Trial", "Treatment"), ("Trial", "Disease")),
    "PREDICTS": (("Biomarker", "Outcome"), ("Gene", "Outcome"), ("Disease", "Outcome")),
    "IMPROVES": (("Drug", "Outcome"), ("Treatment", "Outcome")),
    "WORSENS": (("Drug", "Outcome"), ("Treatment", "Outcome"), ("Gene", "Outcome"), ("Biomarker", "Outcome")),
    "ACTIVATES": (("Gene", "Pathway"), ("Drug", "Pathway"), ("Treatment", "Pathway"), ("Pathway", "Pathway")),
    "INHIBITS": (("Gene", "Pathway"), ("Drug", "Pathway"), ("Treatment", "Pathway"), ("Pathway", "Pathway")),
    "ENHANCES_DELIVERY_OF": (("DeliveryModifier", "Drug"), ("DeliveryModifier", "Treatment")),
    "SYNERGIZES_WITH": (("Treatment", "Treatment"), ("Drug", "Drug"), ("Drug", "Treatment"), ("Treatment", "Drug")),
    "TRANSITIONS_TO": (("CellState", "CellState"),),
    "MODULATES_POLARIZATION_OF": (("Drug", "CellType"), ("Treatment", "CellType")),
    "HAS_EVIDENCE": tuple((x, "EvidenceLevel") for x in _ENDS),
}

#: (relation, trigger patterns in order, confidence); label pairs are those of ALLOWED_EDGES, but for RULE_PAIRS
RELATION_RULES = (
    ("PREDICTS", (r"\bpredicts?\b", r"\bpredicted\b", r"\bpredictive of\b", r"\bbiomarker[s]? of response\b"), 0.62),
    ("ASSOCIATED_WITH", (r"\bassociated with\b", r"\bassociation with\b", r"\bcorrelates? with\b", r"\bcorrelated with\b", r"\blinked to\b"), 0.58),
    ("TARGETS", (r"\btargets?\b", r"\btargeting\b", r"\btargeted\b"), 0.6),
    ("INHIBITS", (r"\binhibits?\b", r"\binhibited\b", r"\binhibition of\b", r"\bblocks?\b", r"\bblockade of\b"), 0.6),
    ("ACTIVATES", (r"\bactivates?\b", r"\bactivated\b", r"\bactivation of\b", r"\bpromotes?\b"), 0.6),
    ("IMPROVES", (r"\bimproves?\b", r"\bimproved\b", r"\bincreases survival\b", r"\bprolongs survival\b", r"\benhances response\b"), 0.57),
    ("WORSENS", (r"\bworsens?\b", r"\bworsened\b", r"\bresistance\b", r"\btoxicity\b"), 0.54),
    ("ENHANCES_DELIVERY_OF", (r"\benhances? delivery of\b", r"\bincreases? delivery of\b", r"\bimproves? delivery of\b", r"\bblood-brain barrier opening\b"), 0.64),
    ("SYNERGIZES_WITH", (r"\bsynergizes? with\b", r"\bsynergy with\b", r"\bsynergistic with\b", r"\bcombined with\b", r"\bcombination with\b"), 0.56),
    ("TRANSITIONS_TO", (r"\btransitions? to\b", r"\bplasticity toward\b", r"\bshift[s]? toward\b"), 0.53),
    ("MODULATES_POLARIZATION_OF", (r"\breprograms?\b", r"\bpolarization\b", r"\bpolarizes?\b", r"\bmodulates? polarization\b"), 0.55),
)
#: A rule's pairs where they are fewer than the allowed ones
RULE_PAIRS = {"ASSOCIATED_WITH": tuple(p for p in ALLOWED_EDGES["ASSOCIATED_WITH"] if p != ("Trial", "Disease"))}

#: Tier, confidence, cue patterns; the first tier with a cue counts
EVIDENCE_RULES = (
    (5, 0.82, (r"\brandomi[sz]ed\b", r"\bphase\s*(?:iii|3)\b")),
    (4, 0.76, (r"\bphase\s*(?:i/ii|1/2|ii|2|i|1)\b", r"\bclinical trial\b")),
    (3, 0.68, (r"\bretrospective\b", r"\bcohort\b", r"\bpatient[s]?\b")),
    (2, 0.62, (r"\bmouse\b", r"\bmurine\b", r"\bxenograft\b")),
    (1, 0.58, (r"\bin vitro\b", r"\bcell line[s]?\b", r"\borganoid[s]?\b")),
)

ALIASES = {
    "gbm": "glioblastoma", "glioblastoma multiforme": "glioblastoma", "tmz": "temozolomide", "pd1": "PD-1", "pd-1": "PD-1", "pdl1": "PD-L1", "pd-l1": "PD-L1", "egfr": "EGFR",
    "mgmt": "MGMT", "idh1": "IDH1", "idh2": "IDH2", "voranigo": "vorasidenib", "ag-881": "vorasidenib", "2hg": "D-2-hydroxyglutarate", "d-2hg": "D-2-hydroxyglutarate",
    "fycompa": "perampanel", "ampar": "AMPA receptor", "gria2": "GRIA2", "plx3397": "pexidartinib", "turalio": "pexidartinib", "tam": "tumor-associated macrophage",
    "tams": "tumor-associated macrophage", "m1 macrophage": "M1 macrophage", "m2 macrophage": "M2 macrophage", "fus": "focused ultrasound", "mr-fus": "MR-guided focused ultrasound",
    "bbbo": "blood-brain barrier opening", "bbbd": "blood-brain barrier disruption", "mes-like": "MES-like", "npc-like": "NPC-like", "opc-like": "OPC-like", "ac-like": "AC-like",
}

LABEL_ALIASES = {
    "GENE": "GENE", "GENES": "GENE", "PROTEIN": "GENE", "BIOLOGICAL STRUCTURE": "CELL_TYPE", "CHEMICAL": "DRUG", "CHEMICALS": "DRUG", "DRUG": "DRUG", "DRUGS": "DRUG", "MEDICATION": "DRUG",
    "DISEASE": "DISEASE", "DISEASES": "DISEASE", "DISORDER": "DISEASE", "DISEASE DISORDER": "DISEASE", "SIGN SYMPTOM": "DISEASE", "PATHWAY": "PATHWAY", "BIOMARKER": "BIOMARKER",
    "BIOLOGICAL ATTRIBUTE": "BIOMARKER", "LAB VALUE": "BIOMARKER", "CELL": "CELL_TYPE", "CELL LINE": "CELL_TYPE", "CELL TYPE": "CELL_TYPE", "CELL STATE": "CELL_STATE",
    "TREATMENT": "TREATMENT", "THERAPY": "TREATMENT", "THERAPEUTIC PROCEDURE": "TREATMENT", "DELIVERY MODIFIER": "DELIVERY_MODIFIER", "OUTCOME": "OUTCOME", "SURVIVAL": "OUTCOME",
    "TRIAL PHASE": "TRIAL_PHASE",
}

#: Entity label -> node label; TRIAL_PHASE and UNKNOWN are never nodes
NODE_OF_ENTITY = {"GENE": "Gene", "DRUG": "Drug", "DISEASE": "Disease", "PATHWAY": "Pathway", "BIOMARKER": "Biomarker", "CELL_TYPE": "CellType", "CELL_STATE": "CellState", "TREATMENT": "Treatment", "DELIVERY_MODIFIER": "DeliveryModifier", "OUTCOME": "Outcome"}

LEXICON = (
    ("glioblastoma", "DISEASE"), ("GBM", "DISEASE"), ("MGMT methylation", "BIOMARKER"), ("MGMT", "GENE"), ("EGFR amplification", "BIOMARKER"), ("EGFR", "GENE"), ("IDH-wildtype", "BIOMARKER"),
    ("IDH wildtype", "BIOMARKER"), ("IDH-mutant", "BIOMARKER"), ("IDH mutant", "BIOMARKER"), ("temozolomide resistance", "OUTCOME"), ("temozolomide response", "OUTCOME"), ("temozolomide", "DRUG"),
    ("TMZ", "DRUG"), ("immunotherapy", "TREATMENT"), ("CAR-T", "TREATMENT"), ("dendritic cell vaccine", "TREATMENT"), ("checkpoint inhibitor", "TREATMENT"), ("blood-brain barrier", "DELIVERY_MODIFIER"),
    ("focused ultrasound", "DELIVERY_MODIFIER"), ("glioblastoma stem cells", "CELL_TYPE"), ("stem cells", "CELL_TYPE"), ("recurrence", "OUTCOME"), ("survival", "OUTCOME"), ("response", "OUTCOME"),
)
LEXICON_SCORE = 0.75

#: Qualifier values, first match: (value, substrings of the lower-case sentence)
SPECIES = (("cell_line", ("in vitro", "cell line", "cell-line")), ("organoid", ("organoid",)), ("xenograft", ("xenograft", "pdx")), ("mouse", ("mouse", "murine")), ("rat", ("rat ", " rat")), ("human", ("patient", "human", "clinical")))
PHASES = (("phase_iii", ("phase iii", "phase 3")), ("phase_ii", ("phase ii", "phase 2")), ("phase_i_ii", ("phase i/ii", "phase 1/2")), ("phase_i", ("phase i", "phase 1")))
CONTEXTS = (("randomized", ("randomized", "randomised")), ("retrospective", ("retrospective",)), ("prospective", ("prospective",)), ("case_report", ("case report",)), ("preclinical", ("preclinical",)))
MUTATIONS = (
    ("idh_wildtype", ("idh-wildtype", "idh wildtype", "idh-wt")),
    ("idh_mutant", ("idh-mutant", "idh mutant", "idh-mutated")),
    ("mgmt_methylated", ("mgmt methylated", "mgmt-methylated")),
    ("mgmt_unmethylated", ("mgmt unmethylated", "mgmt-unmethylated")),
    ("egfr_amplified", ("egfr amplified", "egfr amplification")),
)

PRIORITY = {"invalid evidence prediction label": 50, "missing research-use warning": 40, "missing source PMID": 35, "missing evidence text": 30, "tier-change-sensitive evidence": 25, "pmid already present in graph": 20}
PRIORITY_PREFIX = (("confidence <", 15), ("checkpoint status:", 10))
SAFE_STATUSES = ("research_candidate", "candidate")
REVIEW_STATUSES = ("pending", "accepted", "corrected", "rejected")
WITHDRAWN = ("withdrawn", "rejected", "removed", "excluded")
ADJUDICATED = ("review_status", "corrected_relation_type", "corrected_evidence_tier", "relation_type", "evidence_tier", "predicted_evidence_tier")
PROHIBITED = (r"\bis intended for diagnosis\b", r"\bis intended for treatment selection\b", r"\bclinical decision support system\b", r"\bvalidated clinical accuracy\b", r"\btreatment recommendation\b")
NEGATIONS = ("not ", "must not ", "never ", "out of scope", "prohibited")
FORBIDDEN_PARTS = (".venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache")
FORBIDDEN_SUFFIXES = (".bin", ".ckpt", ".h5", ".onnx", ".pt", ".pth", ".safetensors")
MAX_FILE_BYTES = 10 * 1024 * 1024
#: Notice that reviewed rows carry; a parameter wherever it is compared
NOTICE = "Research-use only. Not medical advice. Not intended for diagnosis, treatment selection, or clinical decision-making."
