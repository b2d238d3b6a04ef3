"""Small dimensions: trust, weights, synonyms, skills, calling codes."""

from __future__ import annotations

# Trust of sources and extraction methods, and weights of the overall confidence.
SOURCE_TRUST = {"csv": 0.9, "ats_json": 0.88, "github": 0.85, "linkedin": 0.8, "resume": 0.75, "notes": 0.55}
METHOD_TRUST = {"structured_field": 1.0, "api_field": 0.97, "labeled_field": 0.85, "regex_extraction": 0.7, "heuristic": 0.6}
OVERALL_WEIGHTS = {"full_name": 3, "emails": 3, "phones": 2, "location.country": 1, "headline": 1, "skills": 2, "experience": 2, "education": 1, "links": 1}

# Headers of tabular sources by slot.
CSV_HEADERS = {
    "full_name": ["name", "full name", "fullname", "candidate", "candidate name"],
    "email": ["email", "email address", "e mail", "mail", "emails"],
    "phone": ["phone", "phone number", "mobile", "mobile number", "contact", "contact number", "telephone", "cell"],
    "company": ["current company", "company", "employer", "organization", "organisation", "current employer"],
    "title": ["title", "current title", "job title", "role", "designation", "position"],
    "headline": ["headline", "summary", "tagline"],
    "location": ["location", "based in", "address"],
    "city": ["city", "town"],
    "region": ["region", "state", "province"],
    "country": ["country", "nation"],
    "linkedin": ["linkedin", "linkedin url", "linkedin profile"],
    "github": ["github", "github url", "github profile"],
    "portfolio": ["portfolio", "website", "personal site", "site"],
    "skills": ["skills", "skill set", "key skills", "skillset"],
    "years_experience": ["years of experience", "years experience", "experience", "yoe", "total experience"],
}

# Keys of structured records by slot, in order of priority.
ATS_KEYS = {
    "full_name": ["full_name", "name", "candidate_name", "display_name"],
    "first": ["first_name", "firstname", "given_name"],
    "last": ["last_name", "lastname", "family_name", "surname"],
    "email": ["primary_email", "email", "email_address", "alternate_emails", "emails"],
    "phone": ["mobile", "phone", "phone_number", "mobile_number", "contact_number", "phones"],
    "headline": ["headline", "current_title", "title", "role", "summary"],
    "years": ["years_experience", "years_of_experience", "experience_years", "yoe"],
    "location": ["location", "address", "geo"],
    "city": ["city", "town", "locality"],
    "region": ["region", "state", "province"],
    "country": ["country", "country_code", "nation"],
    "flat_city": ["city", "location_city"],
    "flat_country": ["country", "country_code", "location_country"],
    "links": ["social_links", "links", "profiles", "socials"],
    "linkedin": ["linkedin", "linkedin_url", "linkedin_profile"],
    "github": ["github", "github_url", "github_profile"],
    "portfolio": ["portfolio", "website", "personal_site", "url"],
    "skills": ["skills", "tags", "skill_tags", "competencies"],
    "history": ["work_history", "experience", "positions", "jobs", "employment"],
    "schools": ["education", "schools", "degrees", "academics"],
    "many": ["candidates", "applicants", "results", "data", "records"],
    "one": ["applicant", "candidate", "profile"],
}
ATS_EXPERIENCE = {
    "company": ["company", "org", "organization", "employer", "company_name"],
    "title": ["title", "role", "position", "job_title"],
    "start": ["start", "from", "start_date", "started"],
    "end": ["end", "to", "end_date", "ended"],
    "summary": ["summary", "notes", "description"],
}
ATS_EDUCATION = {
    "institution": ["institution", "school", "name", "university", "college"],
    "degree": ["degree", "qualification", "credential"],
    "field": ["field", "major", "field_of_study", "discipline"],
    "end_year": ["end_year", "graduated", "graduation_year", "year", "grad_year"],
}

# Labels of note lines and headers of résumé sections.
NOTE_LABELS = {
    "name": "full_name", "candidate": "full_name", "email": "email", "e-mail": "email", "mail": "email", "phone": "phone",
    "mobile": "phone", "contact": "phone", "tel": "phone", "telephone": "phone", "cell": "phone", "linkedin": "links.linkedin",
    "github": "links.github", "portfolio": "links.portfolio", "website": "links.portfolio", "site": "links.portfolio",
    "skills": "skill", "expertise": "skill", "stack": "skill", "location": "location.city", "based in": "location.city",
    "headline": "headline", "summary": "headline",
}
SECTIONS = {
    "skills": "skills", "technical skills": "skills", "skills summary": "skills", "core competencies": "skills",
    "education": "education", "experience": "experience", "work experience": "experience",
    "professional experience": "experience", "employment": "experience",
}
# Patterns of contacts, roles, dates and degrees in free text.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+|00)[0-9][0-9\s().-]{6,}[0-9]"
WEB = r"\b(?:https?://|www\.)[^\s,;)]+|\b(?:linkedin\.com|github\.com)/[^\s,;)]+"
YEARS_OF = r"([0-9]{1,2})\+?\s*(?:years?|yrs?)\b"
ROLE_AT = r"\b(?:[Cc]urrently\s+)?(?:a |an )?([A-Za-z][A-Za-z+/ &]{2,40}?)\s+at\s+([A-Z][A-Za-z0-9&.,' -]{1,40})"
LABELLED = r"^\s*([A-Za-z][A-Za-z ./-]*?)\s*[:\-]\s*(.+)\Z"
DEGREE = r"\b(B\.?Tech|B\.?E|M\.?Tech|M\.?E|B\.?Sc|M\.?Sc|B\.?A|M\.?A|Ph\.?D|MBA|Bachelor(?:'s)?|Master(?:'s)?|Diploma)\b"
DATE_IN_TEXT = r"[A-Za-z]{3,9}\.?\s*[0-9]{4}|[0-9]{1,2}[/-][0-9]{4}|[0-9]{4}-[0-9]{2}"
RANGE = rf"({DATE_IN_TEXT})\s*(?:-|–|—|to)\s*({DATE_IN_TEXT}|present|current)"
YEAR = r"\b(19[0-9]{2}|20[0-9]{2})\b"
PERSON_LINE = r"[A-Za-z][A-Za-z'.-]*(\s+[A-Za-z][A-Za-z'.-]*)*"
SKILL_GROUP = r"^[A-Za-z ]{2,30}:"
FIELD_OF_STUDY, STUDIES = r"\bin\s+([A-Za-z &]{3,40})", r"\bin\s+[A-Za-z &]+"
TITLE_AT_COMPANY = r"(.*?)\s+(?:at|@|—|–|-|,)\s+(.*?)(?:\s*\(|\Z)"

# Blanks, words for now, company suffixes, paths that are no handles, months.
BLANKS = ["", "n/a", "na", "null", "-", "unknown"]
ONGOING = ["present", "current", "now", "ongoing", "till date", "to date"]
COMPANY_SUFFIXES = ["inc", "llc", "ltd", "limited", "corp", "corporation", "co", "gmbh", "plc", "pvt", "private"]
RESERVED_HANDLES = ["orgs", "enterprises", "sponsors", "features", "about", "pricing"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

# Informal country names.
COUNTRY_ALIASES = {
    "uk": "GB", "u.k.": "GB", "u.k": "GB", "britain": "GB", "great britain": "GB", "england": "GB", "scotland": "GB",
    "wales": "GB", "usa": "US", "u.s.": "US", "u.s.a.": "US", "u.s": "US", "america": "US", "uae": "AE", "u.a.e.": "AE",
    "south korea": "KR", "korea, south": "KR", "north korea": "KP", "russia": "RU", "bharat": "IN",
}

# Canonical skills and their other spellings.
SKILLS = {
    "JavaScript": ["js", "ecmascript", "java script", "java-script"], "TypeScript": ["ts"], "Python": ["py", "python3", "python 3"],
    "Java": [], "C++": ["cpp", "cplusplus", "c plus plus"], "C#": ["csharp", "c sharp"], "C": ["c lang", "c language"],
    "Go": ["golang"], "Rust": [], "Ruby": [], "PHP": [], "Swift": [], "Kotlin": [], "Scala": [], "SQL": [], "Solidity": [],
    "R": [], "Bash": ["shell", "shell scripting", "sh"], "HTML": ["html5"], "CSS": ["css3"], "Sass": ["scss"],
    "React": ["reactjs", "react.js"], "Next.js": ["nextjs", "next js", "next"], "Vue.js": ["vue", "vuejs", "vue.js"],
    "Angular": ["angularjs", "angular.js"], "Svelte": ["sveltejs"], "Redux": [], "Tailwind CSS": ["tailwind", "tailwindcss"],
    "Node.js": ["node", "nodejs", "node js"], "Express.js": ["express", "expressjs"], "Django": [], "Flask": [],
    "FastAPI": ["fast api"], "Spring": ["spring boot", "springboot"], "Ruby on Rails": ["rails", "ror"],
    ".NET": ["dotnet", "dot net", "asp.net", "aspnet"], "GraphQL": ["graph ql"],
    "PostgreSQL": ["postgres", "postgre", "psql", "postgresql"], "MySQL": ["my sql"], "MongoDB": ["mongo"], "Redis": [],
    "SQLite": [], "Elasticsearch": ["elastic search", "elastic"], "Cassandra": [], "DynamoDB": ["dynamo db", "dynamo"],
    "Firebase": ["firestore"], "Supabase": [], "AWS": ["amazon web services"], "GCP": ["google cloud", "google cloud platform"],
    "Azure": ["microsoft azure"], "Docker": [], "Kubernetes": ["k8s", "kube"], "Terraform": [], "Ansible": [], "Jenkins": [],
    "GitHub Actions": ["gh actions"], "CI/CD": ["cicd", "ci cd", "continuous integration", "continuous delivery"],
    "Machine Learning": ["ml"], "Deep Learning": ["dl"], "NLP": ["natural language processing"], "Computer Vision": ["cv"],
    "TensorFlow": ["tensor flow", "tf"], "PyTorch": ["torch"], "scikit-learn": ["sklearn", "scikit learn", "sci-kit learn"],
    "Pandas": [], "NumPy": ["numpy"], "Keras": [], "LangChain": ["lang chain"], "Git": [], "Linux": [],
    "REST": ["rest api", "restful", "restful api"], "gRPC": ["grpc"], "Kafka": ["apache kafka"], "RabbitMQ": ["rabbit mq"], "Celery": [],
}

# National numbers by calling code, from public numbering plans (coarser than a full plan): region, pattern.
CALLING = {
    "1": ("US", r"[2-9](?:[02-9]\d|1[02-9])[2-9]\d{6}"), "7": ("RU", r"[3-9]\d{9}"), "20": ("EG", r"1[0-25]\d{8}|[2-9]\d{7,8}"),
    "27": ("ZA", r"[1-8]\d{8}"), "30": ("GR", r"[26]\d{9}"), "31": ("NL", r"[1-9]\d{8}"), "32": ("BE", r"4\d{8}|[1-9]\d{7}"),
    "33": ("FR", r"[1-9]\d{8}"), "34": ("ES", r"[5-9]\d{8}"), "36": ("HU", r"[2-7]\d{8}|1\d{7}"), "39": ("IT", r"3\d{8,9}|0\d{5,10}"),
    "40": ("RO", r"[237]\d{8}"), "41": ("CH", r"[2-9]\d{8}"), "43": ("AT", r"[1-9]\d{6,12}"), "44": ("GB", r"7[1-9]\d{8}|[1-3]\d{8,9}|[58]\d{9}"),
    "45": ("DK", r"[2-9]\d{7}"), "46": ("SE", r"[1-9]\d{6,8}"), "47": ("NO", r"[2-9]\d{7}"), "48": ("PL", r"[1-9]\d{8}"),
    "49": ("DE", r"1[5-7]\d{8,9}|[2-9]\d{5,10}"), "52": ("MX", r"[1-9]\d{9}"), "54": ("AR", r"9?[1-9]\d{9}"), "55": ("BR", r"[1-9]\d(?:9\d{8}|[2-5]\d{7})"),
    "56": ("CL", r"[29]\d{8}"), "57": ("CO", r"[36]\d{9}"), "60": ("MY", r"1\d{8,9}|[3-9]\d{7,8}"), "61": ("AU", r"[2-478]\d{8}"),
    "62": ("ID", r"8\d{8,11}|[2-79]\d{6,9}"), "63": ("PH", r"9\d{9}|[2-8]\d{7,9}"), "64": ("NZ", r"2\d{7,9}|[34679]\d{7}"), "65": ("SG", r"[3689]\d{7}"),
    "66": ("TH", r"[689]\d{8}|[2-7]\d{7}"), "81": ("JP", r"[789]0\d{8}|[1-9]\d{8}"), "82": ("KR", r"1\d{8,9}|[2-6]\d{7,9}"), "84": ("VN", r"[35789]\d{8}|2\d{9}"),
    "86": ("CN", r"1[3-9]\d{9}|[2-9]\d{8,10}"), "90": ("TR", r"[2-5]\d{9}"), "91": ("IN", r"[6-9]\d{9}|[1-5]\d{9}"), "92": ("PK", r"3\d{9}|[2-9]\d{8,9}"),
    "94": ("LK", r"[1-9]\d{8}"), "234": ("NG", r"[789]\d{9}"), "254": ("KE", r"[17]\d{8}"), "351": ("PT", r"[29]\d{8}"), "353": ("IE", r"8\d{8}|[1-9]\d{6,8}"),
    "358": ("FI", r"[1-9]\d{5,10}"), "380": ("UA", r"[3-9]\d{8}"), "420": ("CZ", r"[2-79]\d{8}"), "852": ("HK", r"[2-9]\d{7}"), "880": ("BD", r"1[3-9]\d{8}"),
    "886": ("TW", r"9\d{8}|[2-8]\d{7,8}"), "966": ("SA", r"5\d{8}|1\d{8}"), "971": ("AE", r"5\d{8}|[2-9]\d{7}"), "972": ("IL", r"5\d{8}|[2-9]\d{7}"), "977": ("NP", r"9\d{9}"),
}
