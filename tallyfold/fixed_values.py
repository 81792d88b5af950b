"""Names, formats and word lists that input files and results must agree on.

Everything here is data, not logic. Each table is a default argument of some operator and can be
replaced by the caller.
"""

# --- Fixed values: raw transaction header -> stored column, in stored order, with the value kind.
TARGET_LAYOUT = (
    ("Guichet", "guichet", "text"),
    ("Agence", "agence", "text"),
    ("Compagnie", "compagnie", "text"),
    ("Groupe", "groupe", "text"),
    ("Service", "service", "text"),
    ("Reférence", "reference", "text"),
    ("Ref Partenaire", "ref_partenaire", "text"),
    ("ID Trx Partenaire", "id_trx_partenaire", "text"),
    ("Référence EG", "reference_eg", "text"),
    ("Expéditeur", "expediteur", "text"),
    ("Bénéficiaire", "beneficiaire", "text"),
    ("IdProofBenef", "id_proof_benef", "text"),
    ("Src.", "source", "text"),
    ("Dest.", "destination", "text"),
    ("Dev. Src", "devise_source", "text"),
    ("Numéro Compte", "numero_compte", "text"),
    ("Intitulé Compte", "intitule_compte", "text"),
    ("Com_Gui_Envoyeur", "com_gui_envoyeur", "number"),
    ("Com_Age_Envoyeur", "com_age_envoyeur", "number"),
    ("Com_Cmp_Envoyeur", "com_cmp_envoyeur", "number"),
    ("Com_Grp_Envoyeur", "com_grp_envoyeur", "number"),
    ("Com_Grp_Envoyeur_Dev", "com_grp_envoyeur_dev", "number"),
    ("Com_Sys_Envoie", "com_sys_envoie", "number"),
    ("Com_Sys_Envoie_Dev", "com_sys_envoie_dev", "number"),
    ("Montant", "montant", "number"),
    ("Frais HT", "frais_ht", "number"),
    ("TVA", "tva", "number"),
    ("Autres taxes", "autres_taxes", "number"),
    ("Frais TTC", "frais_ttc", "number"),
    ("Total", "total", "number"),
    ("Dev. Dest", "devise_destination", "text"),
    ("Montant à percevoir", "montant_a_percevoir", "number"),
    ("Date", "date_transaction", "timestamp"),
    ("Date Paiement", "date_paiement", "timestamp"),
    ("Date Annulation", "date_annulation", "timestamp"),
    ("Date Remboursement", "date_remboursement", "timestamp"),
    ("Date Dernière Modification", "date_derniere_modification", "timestamp"),
    ("Statut", "statut", "text"),
    ("Guichet Payeur", "guichet_payeur", "text"),
    ("Agence Payeur", "agence_payeur", "text"),
    ("Compagnie Payeur", "compagnie_payeur", "text"),
    ("Groupe Payeur", "groupe_payeur", "text"),
    ("Com_Gui_Payeur", "com_gui_payeur", "number"),
    ("Com_Age_Payeur", "com_age_payeur", "number"),
    ("Com_Cmp_Payeur", "com_cmp_payeur", "number"),
    ("Com_Grp_Payeur", "com_grp_payeur", "number"),
    ("Com_Grp_Payeur_Dev", "com_grp_payeur_dev", "number"),
    ("Com_Sys_Paiement", "com_sys_paiement", "number"),
    ("Com_Sys_Paiement_Dev", "com_sys_paiement_dev", "number"),
    ("Autres Taxe P", "autres_taxe_p", "number"),
    ("Remise", "remise", "number"),
    ("Guichetier", "guichetier", "text"),
    ("Guichetier Payeur", "guichetier_payeur", "text"),
    ("TEC", "tec", "number"),
    ("Commission Partenaire", "commission_partenaire", "number"),
    ("TEC Partenaire", "tec_partenaire", "number"),
    ("Status Partenaire", "status_partenaire", "code"),
)
OPTIONAL_INDEX_COLUMN = "#"

# --- Fixed values: accepted date layouts (one-digit fields allowed) and the same fields in ISO order.
# Day-month-year with seconds, year-month-day with seconds, day/month/year with minutes.
TIMESTAMP_LAYOUTS = (
    (r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4}) ([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})\z", "$3-$2-$1 $4:$5:$6"),
    (r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2}) ([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})\z", "$1-$2-$3 $4:$5:$6"),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) ([0-9]{1,2}):([0-9]{1,2})\z", "$3-$2-$1 $4:$5:0"),
)

# --- Fixed values: partner status codes that map to themselves; any other code is kept as it is.
PARTNER_STATUS_CODES = {"CONFIRMED": "CONFIRMED", "CREATED": "CREATED", "Annulé": "Annulé"}

# --- Fixed values: month names in calendar order.
MONTH_NAMES = (
    "janvier", "février", "mars", "avril", "mai", "juin",
    "juillet", "août", "septembre", "octobre", "novembre", "décembre",
)

# --- Fixed values: XML namespace of the supported payment message.
PAYMENT_NAMESPACE = "urn:iso:std:iso:20022:tech:xsd:pain.001.001.09"

# --- Fixed values: customer segment codes per screening route.
SEGMENT_CODES = (("A", "D", "BLACKLIST"), ("B", "A", "PPE"), ("NONE", "A", "RAS"))

# --- Fixed values: characters not allowed in file names.
FILENAME_FORBIDDEN = '<>:"/\\|?*'

# --- Fixed values: extensions counted as code, and words that exclude a directory.
CODE_EXTENSIONS = (
    ".py", ".java", ".js", ".jsx", ".ts", ".tsx", ".html", ".css", ".scss", ".c", ".cpp", ".h",
    ".cs", ".php", ".rb", ".go", ".rs", ".swift", ".kt", ".kts", ".scala", ".sql", ".sh", ".ps1",
)
IGNORED_DIR_WORDS = (
    "node_modules", "venv", "env", ".git", "__pycache__", "build", "dist", "bin", "obj", "target",
)
MAX_COUNTED_BYTES = 10 * 1024 * 1024

# --- Fixed values: extensions (no dot) whose tokens are counted.
TOKEN_EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "html", "css", "txt", "dart")

# --- Fixed values: extensions searched for quoted strings, and prefixes that mark a non-text string.
STRING_EXTENSIONS = (".js", ".jsx", ".tsx", ".ts")
NON_TEXT_PREFIXES = ("http", "www", "/", ".", "@")

# --- Fixed values: directories left out of the tree listing (exact names).
TREE_EXCLUDED = ("node_modules", "data", ".idea", "dist")

# --- Fixed values: file category by extension, and the category of everything else.
FILE_CATEGORIES = (
    (".pdf", "Documents/PDF"),
    (".doc", "Documents/Word"),
    (".docx", "Documents/Word"),
    (".txt", "Documents/Texte"),
    (".odt", "Documents/Texte"),
    (".rtf", "Documents/Texte"),
    (".xls", "Documents/Excel"),
    (".xlsx", "Documents/Excel"),
    (".ppt", "Documents/PowerPoint"),
    (".pptx", "Documents/PowerPoint"),
    (".jpg", "Images/JPG"),
    (".jpeg", "Images/JPG"),
    (".png", "Images/PNG"),
    (".gif", "Images/GIF"),
    (".bmp", "Images/Autres"),
    (".tiff", "Images/Autres"),
    (".svg", "Images/Vectorielles"),
    (".mp4", "Videos/MP4"),
    (".avi", "Videos/AVI"),
    (".mov", "Videos/MOV"),
    (".mkv", "Videos/MKV"),
    (".wmv", "Videos/Autres"),
    (".mp3", "Audio/MP3"),
    (".wav", "Audio/WAV"),
    (".flac", "Audio/FLAC"),
    (".ogg", "Audio/OGG"),
    (".zip", "Archives/ZIP"),
    (".rar", "Archives/RAR"),
    (".7z", "Archives/7Z"),
    (".tar", "Archives/TAR"),
    (".gz", "Archives/GZ"),
    (".exe", "Executables/EXE"),
    (".msi", "Executables/MSI"),
    (".bat", "Executables/Scripts"),
    (".ps1", "Executables/Scripts"),
    (".py", "Code/Python"),
    (".js", "Code/JavaScript"),
    (".html", "Code/HTML"),
    (".css", "Code/CSS"),
    (".java", "Code/Java"),
    (".c", "Code/C_C++"),
    (".cpp", "Code/C_C++"),
    (".h", "Code/C_C++"),
)
OTHER_CATEGORY = "Autres"

# --- Fixed values: rows per INSERT text, and rows looked ahead for a deposit label.
INSERT_BATCH_ROWS = 1000
LABEL_LOOKAHEAD = 4

# --- Fixed values: column numbers of the accounting sheet.
SHEET_COLUMNS = {"debit": 2, "credit": 3, "label": 4, "debit_amount": 5, "credit_amount": 6}

# --- Fixed values: characters Python's str.strip removes in the ASCII range.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
