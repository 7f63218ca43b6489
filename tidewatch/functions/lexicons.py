"""Fixed values of the rule sets: term lists that results depend on, in folded form (lower case, no accents)."""

# Project signals, first match wins, each with its maturity letter.
PROJECT_SIGNALS = [
    ("FINANCING_APPROVED", ["financement approuve", "financement accorde", "finance par", "pret approuve"]),
    ("CONVENTION_SIGNED", ["convention signee", "signature d une convention", "accord signe"]),
    ("BUDGET_ALLOCATED", ["budget alloue", "budget consacre", "enveloppe budgetaire"]),
    ("PROGRAM_APPROVED", ["programme approuve", "programme adopte", "programme lance", "lancement du programme"]),
    ("STUDY_LAUNCHED", ["lancement des etudes", "lancement d etudes", "etudes lancees", "etude lancee"]),
    ("FEASIBILITY_PREPARATION", ["etude de faisabilite", "etudes prealables", "etude prealable"]),
    ("DESIGN_PREPARATION", ["conception architecturale", "phase de conception", "concours architectural"]),
    ("LAND_OR_SITE_PREPARATION", ["site selectionne", "terrain mobilise", "foncier mobilise"]),
    ("PARTNER_SELECTED", ["partenaire selectionne", "partenariat conclu"]),
    ("IMPLEMENTATION_PREPARATION", ["mise en oeuvre prochaine", "preparation de la mise en oeuvre", "lancement prochain"]),
    ("PROJECT_ANNOUNCED", ["projet annonce", "a annonce le projet", "lancement du projet", "lancement officiel du projet", "projet de rehabilitation", "projet d amenagement", "projet de restauration"]),
]
MATURITY = {"A": ["FINANCING_APPROVED", "PROGRAM_APPROVED", "BUDGET_ALLOCATED"], "B": ["CONVENTION_SIGNED", "PROJECT_ANNOUNCED", "PARTNER_SELECTED"]}
PROJECT_SCOPE = ["architecture", "architectural", "rehabilitation", "restauration", "conservation", "medina", "monument", "patrimoine", "batiment historique", "equipement culturel", "espace public", "amenagement urbain", "urbanisme", "planification urbaine", "developpement territorial", "regeneration", "transformation urbaine", "programme de developpement", "investissement public", "valorisation du site", "developpement regional", "strategie territoriale", "gouvernance territoriale", "innovation territoriale", "developpement local", "centre historique", "site archeologique", "ingenierie territoriale"]
PROJECT_OTHER = ["autoroute", "reseau d assainissement", "adduction d eau", "centrale electrique", "materiel medical", "agriculture", "industrie automobile"]
PROJECT_RESCUE = ["architecture", "rehabilitation", "urbanisme"]
PROJECT_DONE = ["projet acheve", "travaux acheves", "inaugure", "mise en service"]
PROJECT_TENDER = ["appel d offres", "marche public", "soumission", "date limite de remise"]
PROJECT_NEWS = ["nouvelle phase", "financement approuve", "convention signee", "lancement des etudes", "lancement prochain"]

# Funding notices: where, what about, phrases that deny, status with letter, access mode.
FUNDING_PLACES = ["maroc", "morocco", "marocaine", "marocain"]
FUNDING_SCOPE = ["architecture", "patrimoine", "heritage", "rehabilitation", "medina", "culturel", "culturelle", "cultural infrastructure", "developpement urbain", "urban development", "urban", "developpement territorial", "territorial development", "territorial", "espace public", "resilience urbaine", "planification", "regeneration", "equipement public", "infrastructure culturelle"]
FUNDING_NOT_OPEN = ["not a specific grant tender or open call", "not an open call", "no open call", "does not announce a direct"]
FUNDING_NO_CONSULTANT = ["does not establish a new financing call consultant opportunity", "no consultant opportunity"]
FUNDING_CLOSED = ["cloture", "closed", "acheve", "completed"]
FUNDING_FRAMEWORK = ["strategic pipeline framework"]
FUNDING_OPEN = ["appel ouvert", "candidatures ouvertes", "open call", "date limite"]
FUNDING_ACTIVE = ["approuve", "approved", "signe", "signed", "en cours", "active", "accord de financement", "financing agreement"]
FUNDING_PREPARED = ["en preparation", "concept note", "preparation"]
FUNDING_DIRECT = ["eligibles", "peut candidater", "apply", "appel a projets", "subvention"]
FUNDING_CONSULTANT = ["consultant", "services de conseil", "consulting services"]
FUNDING_BENEFICIARY = ["plan de passation", "procurement plan", "marches du beneficiaire"]
FUNDING_ASSISTANCE = ["assistance technique", "technical assistance"]
FUNDING_GRANT = ["grant", "subvention"]

# Institutions: activities and roles, first match wins.
INSTITUTION_SCOPE = ["architecture", "architectural", "patrimoine", "culture", "medina", "restauration", "rehabilitation", "urbanisme", "amenagement urbain", "espace public", "developpement territorial", "planification", "regeneration", "equipement culturel", "investissement public", "cadre bati", "developpement regional", "strategie territoriale", "gouvernance territoriale", "innovation territoriale", "developpement local", "politique publique"]
INSTITUTION_ACTIVITIES = [
    ("NEW_APPOINTMENT", ["nomme", "nomination", "nouveau directeur", "nouvelle directrice"]),
    ("LEADERSHIP_CHANGE", ["changement de direction", "nouveau president", "nouvelle presidente"]),
    ("NEW_RESPONSIBILITY", ["charge de", "responsable de", "pilotage du projet"]),
    ("PROGRAM_LAUNCH", ["lance un programme", "lancement du programme", "nouveau programme"]),
    ("RESTRUCTURING", ["restructuration", "reorganisation"]),
    ("PARTNERSHIP", ["convention signee", "partenariat", "accord de cooperation"]),
    ("INVESTMENT_FOCUS", ["programme d investissement", "investissement dans"]),
]
INSTITUTION_ROLES = [
    ("STRATEGIC_DECISION_MAKER", ["ministre", "wali", "gouverneur", "president", "presidente", "directeur general", "directrice generale", "secretaire general"]),
    ("HERITAGE_MANAGER", ["patrimoine", "conservation", "medina"]),
    ("URBANISM_MANAGER", ["urbanisme", "amenagement", "planification urbaine"]),
    ("PROJECT_DIRECTOR", ["directeur de projet", "directrice de projet", "chef de projet"]),
    ("PROCUREMENT_MANAGER", ["marches", "commande publique", "achats"]),
    ("PARTNERSHIP_MANAGER", ["partenariat", "cooperation"]),
    ("PROGRAM_MANAGER", ["programme", "programmes"]),
    ("TECHNICAL_MANAGER", ["directeur technique", "directrice technique", "responsable technique"]),
    ("OPERATIONAL_MANAGER", ["directeur operationnel", "directrice operationnelle"]),
]
INSTITUTION_OBSOLETE = ["ancien directeur", "ancienne directrice", "ex directeur", "a quitte ses fonctions", "remplace par", "mandat termine", "jusqu en 2023", "jusqu en 2024", "jusqu en 2025"]

# Evidence sources of a role, best first, and keywords that rank sentences.
ROLE_SOURCES = ["GOVERNANCE", "ORGANIGRAM", "APPOINTMENT", "OFFICIAL_RELEASE", "OFFICIAL_PROGRAM", "PROFESSIONAL"]
EVIDENCE_KEYWORDS = ["architecture", "patrimoine", "urban", "réhabilitation", "rehabilitation", "convention", "financement", "budget", "nommé", "nomination", "directeur", "loi", "décret", "decret", "adopté", "vigueur", "consultation", "eligible", "procurement", "beneficiary", "morocco", "maroc"]

# French month names, folded.
MONTHS = ["janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre"]

# Title selection: French equivalents of Arabic terms, in the order they are added.
TITLE_EQUIVALENTS = [
    ("دراسة", "etude"), ("دراسات", "etudes"), ("تقنية", "technique"), ("تتبع", "suivi"), ("اشراف", "suivi"),
    ("معمارية", "architecturale"), ("معماري", "architectural"), ("تصميم", "conception"), ("ترميم", "restauration"),
    ("الهندسة المعمارية", "architecture"), ("تثمين", "valorisation"), ("تاهيل", "rehabilitation"),
    ("المدينة العتيقة", "ancienne medina"), ("التراث", "patrimoine"), ("الاسوار", "remparts"), ("القصبة", "kasbah"),
    ("لقصر", "ksar"), ("القصر", "ksar"), ("القصور", "ksour"), ("متحف", "musee"), ("مدرسة", "ecole"), ("مدارس", "ecoles"),
    ("ثانوية", "lycee"), ("اشغال", "travaux"), ("التطهير", "assainissement"), ("الطرق", "voirie"),
]
TITLE_SERVICE = ["etude", "etudes", "suivi", "diagnostic", "expertise", "conception", "maitrise d oeuvre", "charte", "plan d amenagement", "sauvegarde", "controle", "assistance"]
TITLE_CONTEST = ["concours", "consultation architectur", "consultations architectur", "مسابقة"]
TITLE_HERITAGE = ["patrimoine", "patrimonial", "ancienne medina", "medina", "rempart", "muraille", "monument historique", "kasbah", "ksar", "fortification", "historique", "القصور", "القصر", "لقصر"]
TITLE_HERITAGE_PROOF = ["patrimonial", "restauration", "rempart", "monument historique", "sauvegarde"]
TITLE_MAJOR = ["musee", "campus", "universit", "hospital", "hopital", "centre culturel", "complexe culturel", "grand complexe", "siege", "corniche"]
TITLE_UNRELATED = ["informatique", "logiciel", "sauvegarde des donnees", "fournitures", "gardiennage", "nettoyage", "restauration collective", "repas", "patrimoine foncier", "conservation des eaux", "conservation des sols", "معلوماتي", "لوازم", "حراسة"]
TITLE_ORDINARY = ["ecole", "lycee", "scolaire", "ofppt", "logement de fonction", "logements de fonction", "logements du personnel", "logement du personnel", "assainissement", "voirie", "route ", "routes "]
TITLE_UNIVERSITY = ["universit", "campus", "ecole superieure", "enseignement superieur"]
TITLE_MOSQUE = ["mosquee", "mosquees", "مسجد"]
TITLE_PRIORITY = {"A_heritage_service": 1, "C_architectural_competition": 2, "D_major_architecture": 3, "incomplete_scope_requires_detail": 4, "arabic_scope_requires_detail": 4}

# Instruments of policy: scope, what is not meant, types in order of precedence, citations that end an instrument's own words, status terms.
POLICY_SCOPE = ["architecture", "architectural", "patrimoine", "conservation", "urbanisme", "amenagement du territoire", "amenagement urbain", "foncier", "rehabilitation", "medina", "culturel", "regeneration", "espace public", "planification", "developpement territorial", "developpement regional", "strategie territoriale", "gouvernance territoriale", "decentralisation", "innovation territoriale", "tourisme culturel", "site historique", "politique publique"]
POLICY_OTHER = ["rehabilitation fonctionnelle", "reeducation", "functional rehabilitation"]
POLICY_TENDER = ["appel d offres", "marche public", "remise des plis", "adjudicataire"]
POLICY_TYPES = [
    ("DRAFT_LAW", ["projet de loi", "avant projet de loi"]),
    ("LAW", ["loi n", "loi cadre", "loi"]),
    ("DECREE", ["decret"]),
    ("ORDER", ["arrete"]),
    ("CIRCULAR", ["circulaire"]),
    ("PUBLIC_CONSULTATION", ["consultation publique"]),
    ("STRATEGY", ["strategie"]),
    ("PROGRAM", ["programme public", "programme national"]),
    ("REGULATORY_REFORM", ["reforme reglementaire"]),
    ("POLICY_STUDY", ["etude de politique", "etude strategique"]),
    ("PUBLIC_STUDY", ["etude territoriale", "etude urbaine"]),
    ("OFFICIAL_GUIDELINE", ["directive", "guide officiel", "norme"]),
]
POLICY_CITATIONS = ["en application de", "pour l application de", "pris pour application de", "conformement a", "en vertu de"]
POLICY_CONSULTED = ["consultation publique", "commentaires publics", "commentaires du public"]
POLICY_DRAFT_TITLES = ["projet de decret", "projet d arrete"]
POLICY_DENIED = ["non adopte", "pas adopte", "pas encore adopte", "pas en vigueur", "non entre en vigueur", "entrera en vigueur"]
POLICY_IN_FORCE = ["entre en vigueur", "en vigueur"]
POLICY_ADOPTED = ["adopte", "adoptee", "adoption definitive", "promulgue"]
POLICY_APPLIED = ["mise en oeuvre", "application du programme"]
POLICY_PREPARED = ["en preparation", "elaboration en cours", "projet de decret", "projet d arrete"]
POLICY_ANNOUNCED = ["annonce", "annoncee", "lancement"]

# Briefs: what a search is for, what else its topics are called, documents that may be asked for, places with their other names, months.
BRIEF_MODES = {
    "PROCUREMENT": ["marche", "appel d offres", "consultation", "cps", "dce", "bpu", "dqe", "reglement de concours", "صفقة", "طلب عروض"],
    "PROJECTS": ["projet en gestation", "projets en gestation", "projet en preparation", "projets en preparation", "chantier", "etude", "annonce de projet", "مشروع", "دراسة"],
    "INSTITUTIONS": ["qui dirige", "institution", "responsable", "directeur", "nomination"],
    "POLICIES": ["loi", "decret", "reglementation", "strategie publique", "politique publique", "texte"],
    "FUNDING": ["bailleur", "financement", "finance", "subvention", "don", "pret", "fonds", "تمويل", "منحة"],
    "ARTICLES": ["article", "presse", "actualite", "annonce"],
}
BRIEF_TOPICS = {
    "muraille": ["remparts", "fortifications", "enceintes", "bastions", "portes historiques", "murs historiques", "restauration", "conservation", "confortement", "rehabilitation patrimoniale"],
    "valorisation patrimoniale": ["mise en valeur", "sauvegarde", "conservation", "heritage valorisation", "patrimoine culturel", "patrimoine historique", "circuit patrimonial"],
    "patrimoine": ["heritage", "patrimoine culturel", "patrimoine historique", "sauvegarde", "conservation"],
    "etude territoriale": ["ingenierie territoriale", "diagnostic territorial", "strategie territoriale", "planification territoriale"],
}
BRIEF_DOCUMENTS = ["CPS", "RC", "DCE", "BPU", "DQE", "PLANS", "ANNEXES"]
PLACES = {
    "El Jadida": ["el jadida", "mazagan", "cite portugaise", "medina d el jadida"], "Fès": ["fes", "medina de fes", "fes el bali", "fes bali", "fes jdid"],
    "Safi": ["safi", "ksar el bahr", "chateau de mer"], "Marrakech": ["marrakech", "medina de marrakech"], "Tiznit": ["tiznit", "medina de tiznit"],
    "Dakhla": ["dakhla"], "Rabat": ["rabat"], "Casablanca": ["casablanca"], "Essaouira": ["essaouira", "mogador", "medina d essaouira"],
    "Meknès": ["meknes", "medina de meknes"], "Tanger": ["tanger", "tangier"], "Ouarzazate": ["ouarzazate"], "Taroudant": ["taroudant", "medina de taroudant"],
    "Agadir": ["agadir"], "Tétouan": ["tetouan"], "Chefchaouen": ["chefchaouen"], "Béni Mellal": ["beni mellal"], "Laâyoune": ["laayoune"], "Nador": ["nador"],
    "Oujda": ["oujda"], "Kénitra": ["kenitra"], "Salé": ["sale"], "Maroc": ["maroc", "morocco"],
}
