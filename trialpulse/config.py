"""Fixed values of the risk model: weights, thresholds, name lists."""

from __future__ import annotations

# Features in scoring order, with weight and tier.
WEIGHTS: dict[str, tuple[float, str]] = {
    "sae_pending_count": (0.20, "Safety"),
    "uncoded_meddra_count": (0.15, "Safety"),
    "missing_visit_count": (0.12, "Completeness"),
    "missing_pages_count": (0.10, "Completeness"),
    "lab_issues_count": (0.10, "Completeness"),
    "max_days_outstanding": (0.08, "Timeliness"),
    "max_days_page_missing": (0.06, "Timeliness"),
    "uncoded_whodd_count": (0.06, "Coding"),
    "edrr_open_issues": (0.05, "Reconciliation"),
    "n_issue_types": (0.05, "Composite"),
    "inactivated_forms_count": (0.03, "Administrative"),
}

# Issue columns of the subject table, and those whose outliers are capped.
ISSUE_COLUMNS = [
    "missing_visit_count",
    "max_days_outstanding",
    "lab_issues_count",
    "sae_total_count",
    "sae_pending_count",
    "missing_pages_count",
    "max_days_page_missing",
    "uncoded_meddra_count",
    "uncoded_whodd_count",
    "inactivated_forms_count",
    "edrr_open_issues",
]
CAPPED_COLUMNS = ["max_days_outstanding", "max_days_page_missing", "lab_issues_count", "inactivated_forms_count"]
IQR_MULTIPLIER = 3.0
MAX_DAYS = 1825

# Risk thresholds.
MIN_FOR_P95 = 20
SUBJECT_PERCENTILE, SUBJECT_FLOOR, SUBJECT_FALLBACK = 0.90, 0.10, 0.20
SITE_HIGH, SITE_MEDIUM = (0.85, 0.05, 0.10), (0.50, 0.02, 0.05)

# The features summed at site level, and the site keys.
SUMMED = [f for f in WEIGHTS if f != "n_issue_types"]
SITE_KEYS = ["study", "site_id", "country", "region"]
SUBJECT_KEYS = ["study", "subject_id"]

# Site columns in which statistical outliers are sought.
OUTLIER_METRICS = [
    "sae_pending_count_sum",
    "missing_visit_count_sum",
    "lab_issues_count_sum",
    "max_days_outstanding_sum",
    "max_days_page_missing_sum",
    "edrr_open_issues_sum",
    "subject_count",
    "high_risk_count",
]
SEVERITY = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}

# Accepted file-name patterns by file type; the first type that matches wins.
FILE_PATTERNS: dict[str, list[str]] = {
    "edc_metrics": ["CPID.*EDC.*Metrics", "EDC.*Metrics", "CPID_EDC"],
    "visit_tracker": ["Visit.*Projection.*Tracker", "Visit.*Tracker", "Missing.*visit"],
    "missing_lab": ["Missing.*Lab.*Name", "Missing.*LNR", "Lab.*Range", "Missing_Lab"],
    "sae_dashboard": ["eSAE.*Dashboard", "SAE.*Dashboard", "SAE_Dashboard", "eSAE_"],
    "missing_pages": ["Missing.*Pages.*Report", "Global.*Missing.*Pages", "Missing.*Page.*Report", "Missing_page"],
    "meddra_coding": ["GlobalCodingReport.*MedDRA", "MedDRA", "Medra"],
    "whodd_coding": ["GlobalCodingReport.*WHODD", "GlobalCodingReport.*WHODrug", "WHODD", "WHODrug", "WHOdra"],
    "inactivated": ["Inactivated.*Folders", "Inactivated.*Forms", "Inactivated.*Report", "Inactivated"],
    "edrr": ["Compiled.*EDRR", "EDRR", "Compiled_EDRR"],
}

# Accepted headers of each canonical column.
HEADERS: dict[str, dict[str, list[str]]] = {
    "edc_metrics": {
        "subject_id": ["Subject ID", "Subject", "SubjectID", "SUBJECT ID"],
        "site_id": ["Site ID", "Site", "SiteID", "SITE ID", "Site Number"],
        "country": ["Country", "COUNTRY"],
        "region": ["Region", "REGION"],
        "subject_status": ["Subject Status", "Status", "Subject Status (Source: PRIMARY Form)"],
        "latest_visit": ["Latest Visit", "Latest Visit (SV)", "Latest Visit (SV) (Source: Rave EDC: BO4)"],
    },
    "visit_tracker": {
        "subject_id": ["Subject", "Subject ID", "SubjectID"],
        "site_id": ["Site", "Site ID", "Site Number"],
        "country": ["Country"],
        "visit": ["Visit", "Visit Name"],
        "days_outstanding": ["# Days Outstanding", "Days Outstanding", "Days_Outstanding"],
    },
    "missing_lab": {"subject_id": ["Subject", "Subject ID"], "site_id": ["Site number", "Site", "Site ID"], "country": ["Country"], "issue": ["Issue", "Issue Type"]},
    "sae_dashboard": {
        "subject_id": ["Patient ID", "Subject", "Subject ID", "PatientID"],
        "site_id": ["Site", "Site ID"],
        "country": ["Country"],
        "review_status": ["Review Status", "ReviewStatus"],
        "action_status": ["Action Status", "ActionStatus"],
    },
    "missing_pages": {
        "subject_id": ["Subject Name", "SubjectName", "Subject", "Subject ID"],
        "site_id": ["Site Number", "SiteNumber", "SiteGroupName(CountryName)", "SiteGroupName", "Site", "Site ID"],
        "days_missing": ["No. #Days Page Missing", "# of Days Missing", "Days Missing", "#Days Page Missing"],
    },
    "meddra_coding": {"subject_id": ["Subject", "Subject ID"], "coding_status": ["Coding Status", "CodingStatus"]},
    "whodd_coding": {"subject_id": ["Subject", "Subject ID"], "coding_status": ["Coding Status", "CodingStatus"]},
    "inactivated": {"subject_id": ["Subject", "Subject ID"], "site_id": ["Study Site Number", "Site", "Site ID", "Site Number"], "country": ["Country"]},
    "edrr": {"subject_id": ["Subject", "Subject ID"], "open_issues": ["Total Open issue Count per subject", "Open Issues", "Open Issue Count"]},
}

# Issues in running text.
ISSUE_PHRASES = {
    "sae_pending_count": "SAE backlogs",
    "missing_visit_count": "missing visits",
    "missing_pages_count": "missing CRF pages",
    "lab_issues_count": "lab data issues",
    "uncoded_meddra_count": "uncoded adverse events",
    "uncoded_whodd_count": "uncoded medications",
    "edrr_open_issues": "reconciliation issues",
    "inactivated_forms_count": "form corrections",
    "max_days_outstanding": "data entry delays",
    "max_days_page_missing": "long-outstanding pages",
}

# What a pair of issues means ({a}, {b}: phrases; {word}: strength; {lift}: one decimal).
PAIR_TEXTS = {
    "safety": "Safety data entry backlog: Sites with {a} are {word} likely to also have {b}, suggesting resource constraints in safety data processing.",
    "entry": "General data entry issues: {a_title} and {b} {word} co-occur, indicating systemic site capacity problems.",
    "time": "Timeliness correlation: Sites with {a} are {word} likely to have {b}, suggesting chronic data entry delays.",
    "coding": "Coding backlog: Both {a} and {b} {word} co-occur, indicating coding resource constraints.",
    "other": "Sites with {a} are {lift}x more likely to also have {b}.",
}

# Descriptions, contributing factors and actions of root causes.
CAUSES: dict[str, tuple[str, list[str], list[str]]] = {
    "Safety": (
        "Safety data processing backlog causing SAE review delays and coding gaps",
        ["Insufficient safety data management resources", "Complex adverse event narratives requiring specialist review", "Training gaps in safety reporting procedures"],
        ["Hire additional safety data specialists", "Implement SAE triage system to prioritize reviews", "Deploy automated coding suggestions for common terms", "Weekly SAE backlog review meetings"],
    ),
    "Completeness": (
        "Insufficient site data entry capacity causing missing visit and CRF data",
        ["Understaffed clinical sites", "Complex EDC system requiring extensive training", "High patient enrollment outpacing data entry capacity", "Competing priorities at investigator sites"],
        ["Assess site data management staffing levels", "Provide targeted EDC re-training", "Implement data entry reminders and escalation workflows", "Consider centralized data entry support for high-volume sites"],
    ),
    "Geographic": (
        "Regional/country-specific issues in ",
        ["Regional regulatory requirements affecting data collection", "Language barriers impacting training effectiveness", "Local infrastructure limitations", "Cultural differences in clinical trial conduct"],
        ["Deploy region-specific training programs", "Assign dedicated regional monitors", "Translate key documentation to local languages", "Establish regional data management hubs"],
    ),
    "Timeliness": (
        "Chronic data entry delays resulting in stale trial data",
        ["Lack of real-time data entry expectations", "No automated reminders for overdue data", "Site workload imbalances", "Query resolution bottlenecks"],
        ["Implement automated stale data alerts", "Set and communicate data entry SLAs", "Weekly data currency reviews with site coordinators", "Prioritize query resolution to unblock data entry"],
    ),
    "Systemic": (
        "Sites with multiple concurrent issues indicating fundamental capability gaps",
        ["Fundamental site capability gaps", "Inadequate site selection/qualification", "Loss of key site personnel", "Lack of sponsor oversight"],
        ["Conduct site capability assessments", "Implement intensive monitoring protocols", "Consider site remediation plans or replacement", "Assign dedicated site managers"],
    ),
}
