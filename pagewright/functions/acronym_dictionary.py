"""Known acronyms and the words that are none."""

from __future__ import annotations

#: Acronym and definition.
KNOWN: dict[str, str] = {
    "TRL": "Technology Readiness Level",
    "KDP": "Key Decision Point",
    "SRR": "Software Requirements Review",
    "PDR": "Preliminary Design Review",
    "CDR": "Critical Design Review",
    "SIR": "System Integration Review",
    "ORR": "Operational Readiness Review",
    "FRR": "Flight Readiness Review",
    "SAR": "System Acceptance Review",
    "TRR": "Test Readiness Review",
    "PRR": "Production Readiness Review",
    "MRR": "Mission Readiness Review",
    "MDR": "Mission Definition Review",
    "SDR": "System Design Review",
    "DAR": "Design Analysis Review",
    "SE": "Systems Engineering",
    "SEMP": "Systems Engineering Management Plan",
    "RMP": "Risk Management Plan",
    "IMP": "Integrated Master Plan",
    "IMS": "Integrated Master Schedule",
    "WBS": "Work Breakdown Structure",
    "MBSE": "Model-Based Systems Engineering",
    "TPM": "Technical Performance Measure",
    "MOE": "Measure of Effectiveness",
    "MOP": "Measure of Performance",
    "KPP": "Key Performance Parameter",
    "CONOPS": "Concept of Operations",
    "OCD": "Operational Concept Description",
    "ORD": "Operational Requirements Document",
    "SRD": "System Requirements Document",
    "SSRD": "System/Subsystem Requirements Document",
    "ICD": "Interface Control Document",
    "IDD": "Interface Design Document",
    "DID": "Data Item Description",
    "CDD": "Capability Development Document",
    "CPD": "Capability Production Document",
    "CM": "Configuration Management",
    "CCB": "Configuration Control Board",
    "CMMI": "Capability Maturity Model Integration",
    "PLM": "Product Lifecycle Management",
    "VCS": "Version Control System",
    "IV&V": "Independent Verification and Validation",
    "V&V": "Verification and Validation",
    "ATP": "Acceptance Test Procedure",
    "QA": "Quality Assurance",
    "QC": "Quality Control",
    "SQA": "Software Quality Assurance",
    "DT": "Development Testing",
    "OT": "Operational Testing",
    "FMEA": "Failure Mode and Effects Analysis",
    "FMECA": "Failure Modes, Effects, and Criticality Analysis",
    "FTA": "Fault Tree Analysis",
    "PRA": "Probabilistic Risk Assessment",
    "SIL": "Safety Integrity Level",
    "HAZOP": "Hazard and Operability Study",
    "MORT": "Management Oversight and Risk Tree",
    "CRM": "Continuous Risk Management",
    "PM": "Project Manager",
    "PMO": "Program Management Office",
    "SOW": "Statement of Work",
    "PWS": "Performance Work Statement",
    "CLIN": "Contract Line Item Number",
    "EVM": "Earned Value Management",
    "BCWS": "Budgeted Cost of Work Scheduled",
    "BCWP": "Budgeted Cost of Work Performed",
    "ACWP": "Actual Cost of Work Performed",
    "EAC": "Estimate at Completion",
    "ETC": "Estimate to Complete",
    "CPI": "Cost Performance Index",
    "SPI": "Schedule Performance Index",
    "NASA": "National Aeronautics and Space Administration",
    "DOD": "Department of Defense",
    "ESA": "European Space Agency",
    "IEEE": "Institute of Electrical and Electronics Engineers",
    "ISO": "International Organization for Standardization",
    "INCOSE": "International Council on Systems Engineering",
    "AIAA": "American Institute of Aeronautics and Astronautics",
    "SAE": "Society of Automotive Engineers",
    "AS": "Aerospace Standard",
    "MIL-STD": "Military Standard",
    "CAD": "Computer-Aided Design",
    "CAE": "Computer-Aided Engineering",
    "CAM": "Computer-Aided Manufacturing",
    "CFD": "Computational Fluid Dynamics",
    "FEA": "Finite Element Analysis",
    "COTS": "Commercial Off-The-Shelf",
    "GOTS": "Government Off-The-Shelf",
    "MOTS": "Modified Off-The-Shelf",
    "NDI": "Non-Developmental Item",
    "API": "Application Programming Interface",
    "GUI": "Graphical User Interface",
    "CLI": "Command Line Interface",
    "SLC": "System Life Cycle",
    "SDLC": "Software Development Life Cycle",
    "LORA": "Level of Repair Analysis",
    "RAM": "Reliability, Availability, and Maintainability",
    "RMA": "Reliability, Maintainability, and Availability",
    "MTBF": "Mean Time Between Failures",
    "MTTR": "Mean Time To Repair",
    "MTTF": "Mean Time To Failure",
    "MOC": "Mission Operations Center",
    "SOC": "Science Operations Center",
    "FOD": "Flight Operations Directorate",
    "ISS": "International Space Station",
    "LEO": "Low Earth Orbit",
    "GEO": "Geostationary Earth Orbit",
    "MEO": "Medium Earth Orbit",
    "EVA": "Extravehicular Activity",
    "RCS": "Reaction Control System",
    "GNC": "Guidance, Navigation, and Control",
    "ADCS": "Attitude Determination and Control System",
    "TCS": "Thermal Control System",
    "EPS": "Electrical Power System",
    "C&DH": "Command and Data Handling",
    "TT&C": "Telemetry, Tracking, and Command",
}

#: Capitals that are words, not acronyms.
COMMON_WORDS = ("AND", "THE", "FOR", "NOT", "BUT", "ARE", "WAS", "HAS", "HAD", "CAN", "MAY", "USE", "ALL", "ANY", "NEW", "ONE", "TWO", "GET", "SET", "RUN", "END", "OUT")
