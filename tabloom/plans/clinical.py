"""The clinical rule catalogue: which columns derive from which, and which are blank under which parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import bmi, col, offset_date, to_double
from tabloom.operators.profile import Schema
from tabloom.operators.rules import ConditionalBlank, Constraints, Derived, mine

# Column names of the clinical table, and the rules between them.
AGE, AGE_RANGE = "Age::40", (0.0, 120.0)
WEIGHT, HEIGHT, BMI, BMI_TOLERANCE = "Preoperative body weight (kg)::20", "Height (cm)::23", "BMI::24", 2.0
OPERATION = "Date of primary operation (YYYY-MM-DD)::53"
DATE_TOLERANCE = 1.0
DURATIONS = {
    "Termination of intravenous fluid infusion (YYYY-MM-DD)::108": "Duration of IV fluid infusion (nights)::109",
    "First passage of flatus (YYYY-MM-DD)::127": "Time to passage of flatus (nights)::129",
    "First passage of stool (YYYY-MM-DD)::130": "Time to passage of stool (nights)::131",
    "Tolerating solid food (YYYY-MM-DD)::132": "Time to tolerating solid food (nights)::133",
    "Termination of urinary drainage (YYYY-MM-DD)::140": "Time to termination of urinary drainage (nights)::141",
    "Nursed back to preoperative ADL ability (YYYY-MM-DD)::142": "Time to recovery of ADL ability (nights)::143",
    "Termination of epidural analgesia (YYYY-MM-DD)::147": "Time to termination of epidural analgesia (nights)::149",
    "Pain control adequate on oral analgesics (YYYY-MM-DD)::155": "Time to pain control with oral analgesics (nights)::156",
    "Date of discharge (YYYY-MM-DD)::178": "Length of stay (nights in hospital after primary operation)::179",
    "Date of follow-up (YYYY-MM-DD)::232": "Time between operation and follow-up (nights)::235",
}
INACTIVE = ["No"]
BLANKS = {
    "Complications at all during primary stay::183": [
        "Respiratory complication(s)::189",
        "Infectious complication(s)::197",
        "Cardiovascular complication(s)::205",
        "Renal, hepatic, pancreatic and gastrointestinal complication(s)::215",
        "Surgical complication(s)::230",
        "Complication(s) related to epidural or spinal anaesthesia::246",
        "Anaesthetic complication(s)::250",
    ],
    "Respiratory complication(s)::189": ["Lobar atelectasis::190", "Pneumonia::191", "Pleural Fluid::192", "Respiratory failure::193", "Pneumothorax::194", "Other respiratory complication::195"],
    "Infectious complication(s)::197": [
        "Wound Infection::204",
        "Urinary tract infection::203",
        "Intraperitoneal or retroperitoneal abscess::202",
        "Sepsis::201",
        "Septic Shock::200",
        "Infected graft or prosthesis::199",
        "Other infectious complication::198",
    ],
    "Cardiovascular complication(s)::205": [
        "Heart Failure::214",
        "Acute Myocardial Infarction::213",
        "Deep Venous Thrombosis::212",
        "Portal Vein Thrombosis::211",
        "Pulmonary Embolus::210",
        "Cerebrovascular lesion::209",
        "Cardiac arrhythmia::208",
        "Cardiac arrest::207",
        "Other cardiovascular complication::206",
    ],
    "Renal, hepatic, pancreatic and gastrointestinal complication(s)::215": [
        "Renal dysfunction::228",
        "Urinary retention::226",
        "Hepatic dysfunction::225",
        "Pancreatitis::220",
        "Gastrointestinal haemorrhage::219",
        "Nausea or vomiting::218",
        "Obstipation or diarrhoea::217",
        "Other organ dysfunction::216",
    ],
    "Surgical complication(s)::230": [
        "Anastomotic leak::244",
        "Urinary tract injury::243",
        "Mechanical bowel obstruction::241",
        "Postoperative paralytic ileus::240",
        "Deep wound dehiscence::239",
        "Intraoperative excessive haemorrhage::237",
        "Postoperative excessive haemorrhage::236",
        "Other surgical technical complication or injury::234",
        "Hematoma::233",
    ],
    "Complication(s) related to epidural or spinal anaesthesia::246": [
        "Post dural-puncture headache::249",
        "Epidural hematoma or abscess::248",
        "Other EDA or spinal related complication::247",
    ],
    "Anaesthetic complication(s)::250": [
        "Pulmonary aspiration of gastric contents::257",
        "Hypotension::256",
        "Hypoxia::255",
        "Prolonged postoperative sedation::251",
        "Other anaesthetic complication(s)::253",
    ],
    "Complications at all after primary stay::283": [
        "Respiratory complication(s)::297",
        "Infectious complication(s)::312",
        "Cardiovascular complication(s)::282",
        "Renal, hepatic, pancreatic and gastrointestinal complication(s)::298",
        "Surgical complication(s)::325",
        "Complication(s) related to epidural or spinal anaesthesia::326",
        "Anaesthetic complication(s)::331",
    ],
    "Respiratory complication(s)::297": ["Lobar atelectasis::300", "Pneumonia::301", "Pleural Fluid::305", "Respiratory failure::308", "Pneumothorax::307", "Other respiratory complication::303"],
    "Infectious complication(s)::312": [
        "Wound Infection::323",
        "Urinary tract infection::320",
        "Intraperitoneal or retroperitoneal abscess::317",
        "Sepsis::319",
        "Septic Shock::318",
        "Infected graft or prosthesis::314",
        "Other infectious complication::315",
    ],
    "Cardiovascular complication(s)::282": [
        "Heart failure::287",
        "Acute myocardial infarction::288",
        "Deep venous thrombosis::285",
        "Portal Vein Thrombosis::289",
        "Pulmonary embolus::291",
        "Cerebrovascular lesion::294",
        "Cardiac arrhythmia::295",
        "Cardiac arrest::296",
        "Hypertension::316",
        "Other cardiovascular complication::292",
    ],
    "Renal, hepatic, pancreatic and gastrointestinal complication(s)::298": [
        "Renal dysfunction::299",
        "Urinary retention::352",
        "Hepatic dysfunction::302",
        "Pancreatitis::304",
        "Gastrointestinal haemorrhage::306",
        "Nausea or vomiting::310",
        "Obstipation or diarrhoea::311",
        "Incontinence::313",
        "Other organ dysfunction::309",
    ],
    "Surgical complication(s)::325": [
        "Anastomotic leak::324",
        "Urinary tract injury::328",
        "Mechanical bowel obstruction::322",
        "Postoperative paralytic ileus::321",
        "Deep wound dehiscence::340",
        "Intraoperative excessive haemorrhage::339",
        "Postoperative excessive haemorrhage::338",
        "Other surgical technical complication or injury::337",
        "Hematoma::336",
    ],
    "Complication(s) related to epidural or spinal anaesthesia::326": [
        "Post dural-puncture headache::327",
        "Epidural hematoma or abscess::329",
        "Other EDA or spinal related complication::330",
    ],
    "Anaesthetic complication(s)::331": ["Pulmonary aspiration of gastric contents::257", "Hypotension::256", "Hypoxia::255", "Prolonged postoperative sedation::251"],
    "Anastomosis::66": ["Type of anastomosis::67", "Anastomotic technique::68"],
    "Follow-up performed::231": ["Date of follow-up (YYYY-MM-DD)::232", "Time between operation and follow-up (nights)::235", "WHO Performance Score at follow-up::238"],
    "Readmission(s)::280": ["Length of stay for readmissions::354"],
    "Diabetes Mellitus::11": ["Last HbA1c value ((mmol/mol))::28", "Last HbA1c value (Unknown)::28"],
    "Postoperative epidural analgesia::145": ["Time to termination of epidural analgesia (nights)::149", "Successful block?::150"],
    "Epidural or spinal anaesthesia::88": ["Level of insertion::89"],
}


def bmi_rule() -> Derived:
    zero = lambda: (to_double(col(HEIGHT)) == 0) & to_double(col(WEIGHT)).isNotNull() & (to_double(col(WEIGHT)) != 0)
    return Derived(BMI, [WEIGHT, HEIGHT], lambda: bmi(col(WEIGHT), col(HEIGHT)), "numeric", BMI_TOLERANCE, infinite=zero)


def date_rule(target: str, duration: str, missing_rate: float | None) -> Derived:
    return Derived(target, [OPERATION, duration], lambda: offset_date(col(OPERATION), col(duration)), "datetime", DATE_TOLERANCE, missing_rate)


def constraints(df: DataFrame, schema: Schema, blanks: bool = False, mode: str = "overwrite") -> Constraints:
    """What the profile tells, and the catalogue's rules for the columns that are there."""
    found = mine(schema, mode)
    there = set(df.columns)
    if {WEIGHT, HEIGHT, BMI} <= there:
        found.derived.append(bmi_rule())
    if AGE in there:
        found.ranges[AGE] = AGE_RANGE
    pairs = [(t, d) for t, d in DURATIONS.items() if {OPERATION, t, d} <= there]
    if pairs:
        rates = df.agg(*[F.avg(col(t).isNull().cast("double")).alias(f"r{i}") for i, (t, _) in enumerate(pairs)]).first()
        found.derived += [date_rule(t, d, rates[i]) for i, (t, d) in enumerate(pairs)]
    if blanks:
        found.blanks = [ConditionalBlank(p, kids, INACTIVE) for p, kids in BLANKS.items()]
    return found.over(df.columns)
