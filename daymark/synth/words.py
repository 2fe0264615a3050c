"""Vocabulary of the synthetic dataset.  Fixed values: changing one changes the data."""

SURNAMES = (
    "Abbott", "Aldridge", "Barlow", "Bennett", "Calloway", "Carver", "Dalton", "Draper",
    "Ellison", "Everett", "Farrow", "Fenwick", "Garrett", "Gilmore", "Hadley", "Harmon",
    "Ingram", "Irvine", "Jarvis", "Jennings", "Keller", "Kendall", "Lambert", "Langley",
    "Maddox", "Mercer", "Nash", "Norwood", "Oakley", "Osborne", "Parrish", "Pemberton",
    "Quigley", "Quinn", "Radford", "Rowland", "Sawyer", "Sinclair", "Thatcher", "Tillman",
    "Underhill", "Upton", "Vance", "Vaughn", "Wakefield", "Whitaker", "Yardley", "York",
)

FIRST_NAMES = (
    "Ada", "Alan", "Amara", "Anton", "Beatrix", "Boris", "Carmen", "Cyrus", "Dana", "Dmitri",
    "Elena", "Emil", "Farah", "Felix", "Gita", "Gustav", "Hana", "Hugo", "Ines", "Ivan",
    "Jamila", "Jonas", "Kaito", "Klara", "Leila", "Lukas", "Mei", "Mikhail", "Nadia", "Nils",
    "Olga", "Omar", "Petra", "Priya", "Quentin", "Rafael", "Rosa", "Samir", "Sofia", "Tariq",
    "Tessa", "Uma", "Viktor", "Wanda", "Xenia", "Yusuf", "Zara", "Zoltan",
)

COMPANY_ENDINGS = ("Inc.", "Ltd.", "LLC", "Group", "PLC", "Partners")

CITIES = (
    "Ashford", "Birchwood", "Brookhaven", "Cedar Falls", "Clearwater", "Dunmore", "Eastport",
    "Fairview", "Glenwood", "Harborview", "Hillcrest", "Ironbridge", "Juniper Bay", "Kingsford",
    "Lakeside", "Maplewood", "Millbrook", "New Haven", "Northgate", "Oakridge", "Pinehurst",
    "Port Ellis", "Quarry Hill", "Redwood", "Riverton", "Saint Clair", "Silverton", "Southfield",
    "Stonebridge", "Summerville", "Three Oaks", "Unionville", "Valley View", "Westbrook",
    "Willow Creek", "Windham", "Woodstock", "Yellow Springs", "Zephyr Cove", "Zion Hill",
)

JOBS = (
    "Accountant", "Actuary", "Aerospace engineer", "Analyst", "Architect", "Archivist",
    "Auditor", "Biochemist", "Buyer", "Chemical engineer", "Civil engineer", "Copywriter",
    "Data scientist", "Database administrator", "Designer", "Economist", "Editor",
    "Electrical engineer", "Estate manager", "Financial planner", "Geologist", "Hydrologist",
    "Illustrator", "Information officer", "Interpreter", "Journalist", "Land surveyor",
    "Legal executive", "Logistics planner", "Marketing executive", "Mechanical engineer",
    "Network engineer", "Operations manager", "Personnel officer", "Pharmacist",
    "Production manager", "Quality engineer", "Sales executive", "Site manager",
    "Software developer", "Statistician", "Systems analyst", "Tax adviser", "Technical author",
    "Translator", "Transport planner", "Warehouse manager", "Web developer",
)

INDUSTRIES = (
    "Agriculture", "Automotive", "Aviation", "Banking", "Biotechnology", "Construction",
    "Education", "Electronics", "Energy", "Forestry", "Healthcare", "Hospitality", "Insurance",
    "Logistics", "Manufacturing", "Media", "Mining", "Retail", "Software", "Telecommunications",
)

# An industry phrase is one of each.
PHRASE_VERBS = (
    "build", "connect", "deliver", "design", "extend", "integrate", "manage", "maintain",
    "optimise", "scale", "simplify", "transform",
)
PHRASE_ADJECTIVES = (
    "collaborative", "cross-border", "distributed", "efficient", "end-to-end", "flexible",
    "global", "interactive", "local", "open", "reliable", "seamless",
)
PHRASE_NOUNS = (
    "channels", "communities", "content", "infrastructure", "markets", "models", "networks",
    "platforms", "services", "supply chains", "systems", "workflows",
)

FUNCTIONAL_AREAS = ("R&D", "Sales", "Finance", "HR", "Operations")
