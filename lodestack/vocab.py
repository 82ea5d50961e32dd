"""Fixed values that results depend on: vocabularies, markers, bounds and labels."""

from __future__ import annotations

# Capture states and the length and number of markers that make a body usable.
STATUSES = ["usable", "thin", "failed", "duplicate", "needs-review"]
THIN_CHARS = 700
LOOSE_QUORUM = 3

# URL parameters that only track.
TRACKING = [
    "gh_src", "gh_jid", "ref", "referrer", "source", "src", "trk", "trackingid", "lipi", "refid", "lici",
    "recommended", "spreadsheet", "fbclid", "gclid", "mc_cid", "mc_eid", "campaign", "medium",
]

# Phrases of login shells, of content and of sections.
SHELL = [
    "sign in", "log in to apply", "create an account", "please enable javascript", "enable javascript",
    "you need to enable", "verify you are human", "captcha",
]
CONTENT = [
    "responsib", "requirement", "qualificat", "what you", "about the role", "about the job", "you'll", "you will",
    "experience", "we're looking", "what we", "the role", "responsibilities",
]
STRUCTURE = [
    "responsibilities", "requirements", "qualifications", "what you'll do", "what you will do", "what you'll be doing",
    "who you are", "about you", "what we're looking for", "what you bring", "your role", "in this role", "day to day",
    "day-to-day", "skills and experience", "you'll need",
]

# Hosts of applicant tracking systems and job boards, labels that never name an employer, second levels.
ATS_HOSTS = [
    "greenhouse", "lever", "ashbyhq", "myworkdayjobs", "workday", "icims", "smartrecruiters", "bamboohr", "jobvite",
    "rippling", "breezy", "workable",
]
BOARD_HOSTS = [
    "linkedin", "indeed", "glassdoor", "ziprecruiter", "wellfound", "angellist", "builtin", "otta", "dice", "monster",
    "simplyhired", "google", "jobs",
]
DOMAIN_CHROME = [
    "careers", "career", "jobs", "job", "www", "apply", "boards", "board", "work", "hire", "hiring", "talent",
    "recruiting", "join", "my", "app", "web",
]
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "edu", "ac"]

# Words of job titles that say nothing about the role.
TITLE_STOP = [
    "the", "and", "for", "with", "senior", "staff", "lead", "principal", "junior", "sr", "jr", "ii", "iii", "careers",
    "career", "jobs", "job", "remote", "hybrid", "onsite", "role", "position", "opening", "apply", "hiring",
]

# Tracker states, colours and labels.
TRACKER_STATUS = [
    "**Currently In Talks**", "Applied: Awaiting Response", "Apply Again??", "Apply ASAP: High Prio",
    "Apply Eventually: Apply If Time", "Apply Eventually: Backup Lane",
    "Apply Eventually: On Ice (Applied to Another Position at this Company)", "Apply Eventually: Or Skip It",
    "Declined (Applied, Rejected)", "Down (Applied, No Response)", "Down: Closed Before Applying", "Down: Ruled Out",
    "Interviewed: Rejected",
]
GREEN, YELLOW, ORANGE, RED = "42FF35", "FDFF43", "FA9C31", "F82C1F"

# Short names of cities by what postings write.
CITY_SHORT = {
    "nyc": "NYC", "new york": "NYC", "new york city": "NYC", "manhattan": "NYC", "brooklyn": "NYC", "nyc metro": "NYC",
    "sf": "SF", "san francisco": "SF", "san francisco bay area": "SF", "sf bay area": "SF", "bay area": "SF",
    "la": "LA", "los angeles": "LA",
    "dc": "DC", "d.c.": "DC", "washington dc": "DC", "washington d.c.": "DC", "washington, d.c.": "DC",
}
# Words of locations that name no city, and texts that say nothing.
NO_CITY = [
    "remote", "hybrid", "onsite", "on-site", "on site", "in-office", "in office", "office", "irl", "required",
    "full-time", "full time", "days", "day", "week", "location", "working location", "workplace", "hq",
    "headquarters", "or", "and", "the", "in", "at", "attend", "must", "per", "hub", "hubs", "offices", "site",
    "sites", "based", "near", "fully", "mostly", "primarily", "largely", "partially", "partly", "entirely",
    "completely", "anywhere", "nationwide", "worldwide", "global", "globally", "optional", "preferred", "home",
    "wfh", "onsite/hybrid", "us", "usa", "u.s.", "u.s.a.", "united states", "america", "north america",
]
NO_SIGNAL = [
    "", "unknown", "unclear", "n/a", "na", "none", "not posted", "not specified", "not stated", "tbd",
    "could not verify", "?", "??",
]
NO_QUALIFIER = [
    "first", "friendly", "or", "and", "in", "at", "the", "day", "days", "office", "offices", "hybrid", "onsite",
    "remote", "based",
]

# Profile-fit bands with their lower edges, grades by rank, and flags that a scorer sets itself.
BANDS = {"0-29": 0, "30-49": 30, "50-67": 50, "68-81": 68, "82-96": 82, "97-100": 97}
GRADES = ["absent", "light", "transferable", "direct"]
SEMANTIC_FLAGS = ["hiring_thesis_ambiguous", "centrality_ambiguous", "independent_gap_ambiguity", "posting_requirement_conflict"]

# The weights of a final score and what it starts an application as.
WEIGHTS = {"desire": 0.35, "market": 0.30, "style": 0.20, "practicality": 0.15}
FIRST_STATUS = {80: "Apply ASAP: High Prio", 70: "Apply Eventually: Apply If Time", 60: "Apply Eventually: Backup Lane"}
LAST_STATUS = "Apply Eventually: Or Skip It"

# Metros by the names that fold into them.
METROS = {
    "sf": ["san francisco", "san francisco bay area", "bay area", "sf bay area", "sf", "south san francisco", "oakland"],
    "nyc": ["new york", "new york city", "nyc", "manhattan", "brooklyn", "new york metro"],
    "la": ["los angeles", "la"],
    "dc": ["washington", "washington dc", "washington d.c.", "dc", "arlington"],
    "seattle": ["seattle"], "austin": ["austin"], "boston": ["boston"], "chicago": ["chicago"], "denver": ["denver"], "atlanta": ["atlanta"],
}

# The contract's columns in order, with the default labels of the scores.
CONTRACT = [
    "Applied Date? [You Fill In]", "Status? [You Change]", "Lane", "Company", "Job Post Title + Link",
    "Working Location", "Comp Range", "Have Intro? [You Add]", "Your Notes? [You Add]",
    "Decline/Down Date? [You Add]", "FINAL Weighted Score", "How They May See Your Profile", "Your Desire Score",
    "Culture Fit Score", "Comp + Lifestyle Fit Score", "Posting Last Update", "Top Reasons Notes",
    "Top Concerns Notes", "Profile Score Notes", "Your Desire Score Notes", "Comp + Lifestyle Fit Notes", "Lane Fit",
    "Comp Fit", "Data Completeness", "Job File", "Tailored? (Base Resume)", "Cover Letter Drafted?",
    "Base Resume Score", "Improved Resume Score", "Resume Improvement Delta", "Why It Improves",
]
