"""Fixed values that results depend on: keyword rules, extension classes, aliases, priorities."""

# Version status by keywords of the file name; the first rule with a keyword wins.
VERSION_RULES = (
    (("superseded", "obsolete", "old version"), "superseded"),
    (("final",), "final"),
    (("submitted",), "submitted_version"),
    (("template", "blank"), "template"),
    (("draft", "working", "wip"), "draft"),
)
# Category by keywords of the file name.
CATEGORY_RULES = (
    (("budget", "cost", "price", "financial", "rate table", "rate sheet"), "budget_financial"),
    (("technical", "tech", "volume", "approach", "narrative", "statement of work", "sow"), "proposal_response"),
    (
        ("rfp", "foa", "baa", "nofo", "solicitation", "opportunity", "announcement", "topic", "evaluation criteria"),
        "opportunity_document",
    ),
    (("biosketch", "bio", "cv", "resume", "facilities", "equipment"), "supporting_document"),
    (("letter", "support", "partner", "teaming", "mou"), "partner_document"),
    (("data", "test", "measurement", "spec", "specification"), "technical_data"),
    (("report", "milestone", "deliverable", "final"), "report_or_deliverable"),
    (("presentation", "slides", "deck"), "presentation"),
    (("plan", "internal", "roadmap", "strategy"), "internal_planning"),
)
# Role by keywords of the file name.
ROLE_RULES = (
    (("technical volume", "tech vol", "technical narrative"), "technical_volume"),
    (("project description", "project narrative"), "project_description"),
    (("commercialization", "market", "commercialization plan"), "commercialization_plan"),
    (("statement of work", "sow"), "statement_of_work"),
    (("budget justification", "budget narrative"), "budget_justification"),
    (("budget", "cost"), "budget"),
    (("quad chart", "quadchart"), "quad_chart"),
    (("abstract", "executive summary"), "abstract"),
    (("letter of support", "support letter", "letter"), "letter_of_support"),
    (("facilities", "equipment"), "facilities_document"),
    (("biosketch", "bio sketch", "cv", "resume"), "biosketch"),
    (("data management", "dmp"), "data_management_plan"),
    (("current and pending", "other support"), "current_pending_support"),
    (("evaluation criteria", "evaluation guidance"), "evaluation_criteria"),
    (("foa", "funding opportunity", "nofo"), "foa"),
    (("rfp", "baa", "solicitation"), "rfp"),
    (("topic description", "topic"), "topic_description"),
    (("submission instructions", "instructions"), "submission_instructions"),
    (("terms and conditions", "terms"), "terms_and_conditions"),
    (("award notice", "award"), "award_notice"),
    (("review", "feedback", "reviewer comments"), "review_feedback"),
    (("milestone report", "progress report", "milestone"), "milestone_report"),
    (("final report",), "final_report"),
)
# Category by extension, where no keyword fits.
EXTENSION_CATEGORY = {
    ".pdf": "proposal_response", ".docx": "proposal_response", ".doc": "proposal_response",
    ".xlsx": "budget_financial", ".xls": "budget_financial", ".csv": "technical_data",
    ".txt": "supporting_document", ".md": "internal_planning",
}
# Words that mark money and personal information.
BUDGET_WORDS = (
    "budget", "cost", "pricing", "billing rate", "labor rate", "indirect rate", "rate table", "rate sheet", "financial",
)
PERSONAL_WORDS = ("ssn", "social security", "personal", "pii", "biosketch", "salary")
# Program and agency by words of the collection's name.
PROGRAM_RULES = ((("sbir",), "SBIR"), (("sttr",), "STTR"), (("foa",), "FOA"), (("baa",), "BAA"))
AGENCY_RULES = (
    (("doe", "energy", "arpa-e", "arpa_e"), "DOE"),
    (("dod", "defense", "army", "navy", "air force", "darpa"), "DoD"),
    (("nsf",), "NSF"),
    (("nasa",), "NASA"),
)
# Roles of high and of low value.
HIGH_VALUE_ROLES = (
    "technical_volume", "project_description", "statement_of_work", "award_notice", "review_feedback", "final_report",
    "milestone_report", "commercialization_plan",
)
LOW_VALUE_ROLES = (
    "rfp", "foa", "topic_description", "submission_instructions", "terms_and_conditions", "dfars_clauses",
)
# Extensions by how their files are handled.
DIRECT_EXTENSIONS = (".pdf", ".docx", ".doc", ".csv", ".txt", ".md")
SHEET_EXTENSIONS = (".xlsx", ".xls")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".gif", ".bmp", ".webp")
ZIP_EXTENSIONS = (".zip",)
DECK_EXTENSIONS = (".ppt", ".pptx")
# Treatment by retrieval priority.
TREATMENT_BY_PRIORITY = {"high": "full_document", "medium": "summary_only", "low": "metadata_only", "exclude": "exclude"}
# Least similarity of a tracker match, and how near another row makes it ambiguous.
MATCH_LEAST, MATCH_DELTA = 0.35, 0.05

# Document categories.
CATEGORIES = (
    "opportunity_document", "proposal_response", "supporting_document", "budget_financial", "administrative_compliance",
    "partner_document", "technical_data", "report_or_deliverable", "presentation", "internal_planning", "correspondence",
    "unknown",
)
# Other spellings of values in model responses, by path.
RESPONSE_ALIASES = {
    "document_identity.document_category": {
        "budget": "budget_financial", "budget_spreadsheet": "budget_financial", "opportunity_source": "opportunity_document",
    },
    "document_identity.document_role": {
        "budget_spreadsheet": "budget", "partner_support_letter": "letter_of_support", "support_letter": "letter_of_support",
        "foa_instructions": "submission_instructions",
    },
    "document_identity.origin_type": {
        "generated": "generated_response", "generated_by_team": "generated_response", "generated_internal": "generated_response",
        "partner_generated": "generated_response", "federal_agency": "source_opportunity",
        "opportunity_source": "source_opportunity",
    },
    "opportunity_treatment.recommended_rag_treatment": {
        "full_ingest": "full_document", "full_text": "full_document", "metadata": "metadata_only", "summary": "summary_only",
    },
    "proposal_context.status": {"pre_submission": "drafted", "in_progress": "active", "under_review": "pending"},
}
PROGRAM_PREFIXES = ("SBIR", "STTR", "FOA", "BAA")
# What the wordings of a tracker's status stand for.
STATUS_ALIASES = {
    "draft": "drafted", "drafted": "drafted", "pre_submission": "drafted", "submitted": "submitted", "selected": "selected",
    "awarded": "awarded", "rejected": "rejected", "declined": "rejected", "pending": "pending", "active": "active",
    "completed": "completed",
}
# Allowed values of fields that take one of a list.
AGENCIES = ("DOE", "DoD", "NSF", "NASA", "unknown")
PROGRAMS = ("SBIR", "STTR", "FOA", "BAA", "unknown")
STATUSES = ("drafted", "submitted", "selected", "awarded", "rejected", "pending", "active", "completed", "unknown")
PRIORITIES = ("high", "medium", "low", "exclude")
TREATMENTS = ("full_document", "summary_only", "metadata_only", "exclude")
VERSIONS = ("final", "submitted_version", "draft", "working_version", "superseded", "template", "unknown")
# All roles, origins and labels of documents.
ROLES = tuple(dict.fromkeys([role for _, role in ROLE_RULES] + ["dfars_clauses", "tracker", "unknown"]))
ORIGINS = ("source_opportunity", "generated_response", "post_submission_feedback", "award", "internal_reference", "unknown")
SENSITIVITY_LABELS = (
    "public", "internal", "confidential", "partner_confidential", "financial_sensitive", "export_control_review", "personal_info", "unknown",
)
