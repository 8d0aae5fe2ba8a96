"""Values that results depend on, as given by the annotation scheme and its reference abbreviations."""

# Rewrites of book names, applied in this order; blanks count.
REWRITES = [
    ('1 Col ', '1 Co'),
    ('2 Col ', '2 Co'),
    ('1 C ', '1 Co'),
    ('1 Co o ', '1 Co'),
    ('1 Coh ', '1 Co'),
    ('1 Coo ', '1 Co'),
    ('1 Cor', '1 Co'),
    ('1 Io ', '1 Jn'),
    ('1 R ', '1 K'),
    ('1 Mcc ', '1 M'),
    ('1 Par ', '1 Ch'),
    ('1 Pt ', '1 P'),
    ('1 Rg', '1 S'),
    ('1 T ', '1 Th'),
    ('1 TI ', '1 Tm'),
    ('1 Tt ', '1 Tm'),
    ('1Jn ', '1 Jn'),
    ('1K ', '1 K'),
    ('1T ', '1 Th'),
    ('1Th ', '1 Th'),
    ('1Tm ', '1 Tm'),
    ('2 C ', '2 Co'),
    ('2 Co o ', '2 Co'),
    ('2 Coh ', '2 Co'),
    ('2 Coo ', '2 Co'),
    ('2 Cor', '2 Co'),
    ('2 Io ', '2 Jn'),
    ('2 R ', '2 K'),
    ('2 Mcc ', '2 M'),
    ('2 Par ', '2 Ch'),
    ('2 Pt ', '2 P'),
    ('2 Rg', '2 S'),
    ('2 T ', '2 Th'),
    ('2 TI ', '2 Tm'),
    ('2 Tim ', '2 Tm'),
    ('2 Tt ', '2 Tm'),
    ('2Jn ', '2 Jn'),
    ('2K ', '2 K'),
    ('2S ', '2 S'),
    ('2T ', '2 Th'),
    ('2Th ', '2 Th'),
    ('2Tm ', '2 Tm'),
    ('3 Io ', '3 Jn'),
    ('3 Rg', '1 K'),
    ('4 Rg', '2 K'),
    ('Ab ', 'Ob'),
    ('Act', 'Ac'),
    ('Ag ', 'Hag'),
    ('Agg ', 'Hag'),
    ('Ap ', 'Rv'),
    ('Apc ', 'Rv'),
    ('Bar ', 'Ba'),
    ('Ct ', 'Song'),
    ('Da ', 'Dn'),
    ('Ecl ', 'Qo'),
    ('Ecli ', 'Si'),
    ('Eph ', 'Ep'),
    ('Es ', 'Is'),
    ('Esd ', 'Ezr'),
    ('Esr ', 'Ezr'),
    ('Gal ', 'Ga'),
    ('Gn ', 'Ge'),
    ('Ha ', 'Hab'),
    ('Hb ', 'Heb'),
    ('Hbr ', 'Heb'),
    ('He ', 'Heb'),
    ('Iac ', 'Jm'),
    ('Idc ', 'Jg'),
    ('Ier ', 'Jr'),
    ('Io ', 'Jn'),
    ('Iob ', 'Jb'),
    ('Ioel ', 'Jl'),
    ('Ion ', 'Jon'),
    ('Ios ', 'Jos'),
    ('Ist ', 'Est'),
    ('Iud ', 'Jude'),
    ('Jo ', 'Jn'),
    ('Job', 'Jb'),
    ('Jq ', 'Jc'),
    ('Js ', 'Jos'),
    ('Lam ', 'Lm'),
    ('Lc ', 'Lk'),
    ('Mal ', 'Ml'),
    ('Mc ', 'Mk'),
    ('Os ', 'Hos'),
    ('Phil ', 'Ph'),
    ('Phlm ', 'Phm'),
    ('Prov ', 'Pr'),
    ('Prv ', 'Pr'),
    ('Sap ', 'Ws'),
    ('Sg ', 'Ws'),
    ('So ', 'Ze'),
    ('SP ', 'Ws'),
    ('Sp ', 'Ws'),
    ('Ti ', 'Tt'),
    ('Tit ', 'Tt'),
    ('Tob ', 'Tb'),
]

# Corrections of single references.
CORRECTIONS = [
    ('Ps 15,11', 'Ps 15,10'),
    ('Ac 9,6', 'Ac 9,7'),
]

# Book names and abbreviations; of equal abbreviations the last counts.
BOOKS = [
    ('Genesis', 'Ge'),
    ('Exodus', 'Ex'),
    ('Leviticus', 'Lv'),
    ('Numbers', 'Nm'),
    ('Deuteronomy', 'Dt'),
    ('Joshua', 'Jos'),
    ('Judges', 'Jg'),
    ('Ruth', 'Rt'),
    ('1 Samuel', '1 S'),
    ('2 Samuel', '2 S'),
    ('1 Kings', '1 K'),
    ('2 Kings', '2 K'),
    ('1 Chronicles', '1 Ch'),
    ('2 Chronicles', '2 Ch'),
    ('Ezra', 'Ezr'),
    ('Nehemiah', 'Ne'),
    ('Tobit', 'Tb'),
    ('Judith', 'Jdt'),
    ('Esther', 'Est'),
    ('1 Maccabees', '1 M'),
    ('2 Maccabees', '2 M'),
    ('Job', 'Jb'),
    ('Psalms', 'Ps'),
    ('Proverbs', 'Pr'),
    ('Ecclesiastes', 'Qo'),
    ('Song of Solomon', 'Song'),
    ('Wisdom of Solomon', 'Ws'),
    ('Sirach', 'Si'),
    ('Isaiah', 'Is'),
    ('Jeremiah', 'Jr'),
    ('Lamentations', 'Lm'),
    ('Baruch', 'Ba'),
    ('Ezekiel', 'Ez'),
    ('Daniel', 'Dn'),
    ('Hosea', 'Hos'),
    ('Joel', 'Jl'),
    ('Amos', 'Am'),
    ('Obadiah', 'Ob'),
    ('Jonah', 'Jon'),
    ('Micah', 'Mi'),
    ('Nahum', 'Na'),
    ('Habakkuk', 'Hab'),
    ('Zephaniah', 'Ze'),
    ('Haggai', 'Hag'),
    ('Zechariah', 'Za'),
    ('Malachi', 'Ml'),
    ('Matthew', 'Mt'),
    ('Mark', 'Mk'),
    ('Luke', 'Lk'),
    ('John', 'Jn'),
    ('Acts', 'Ac'),
    ('Romans', 'Rm'),
    ('1 Corinthians', '1 Co'),
    ('2 Corinthians', '2 Co'),
    ('Galatians', 'Ga'),
    ('Ephesians', 'Ep'),
    ('Philippians', 'Ph'),
    ('Colossians', 'Col'),
    ('1 Thessalonians', '1 Th'),
    ('2 Thessalonians', '2 Th'),
    ('1 Timothy', '1 Tm'),
    ('2 Timothy', '2 Tm'),
    ('Titus', 'Tt'),
    ('Philemon', 'Phm'),
    ('Hebrews', 'Heb'),
    ('James', 'Jm'),
    ('1 Peter', '1 P'),
    ('2 Peter', '2 P'),
    ('1 John', '1 Jn'),
    ('1 Jean', '1 Jn'),
    ('2 John', '2 Jn'),
    ('3 John', '3 Jn'),
    ('Jude', 'Jude'),
    ('Revelation', 'Rv'),
    ('Additions to Esther', 'Est (add)'),
    ('3 Ezra', '3 Ezr'),
    ('3 Maccabees', '3 M'),
    ('4 Ezra', '4 Ezr'),
    ('4 Maccabees', '4 M'),
    ('Laodiceans', 'Laod'),
    ('Letter of Jeremiah', 'Ep Jr'),
    ('Odes', 'Od'),
    ('Prayer of Manasseh', 'Man'),
    ('Psalms of Solomon', 'Ps Sol'),
    ('Daniel (Th)', 'Dn (Th)'),
    ('Additions to Daniel', 'Dn (add)'),
    ('Azariah', 'Az'),
    ('Susannah', 'Sus'),
    ('Bel and the dragon', 'Bel'),
    ('Ezra-Nehemiah', 'Ezr-Ne'),
    ('Psalm 151', 'Ps 151'),
    ('Joshua (A)', 'Jos (A)'),
    ('Judges (B)', 'Jg (B)'),
    ('Psalms (Hb)', 'Ps Hb'),
    ('Epistle of Baruch (A)', 'Ep Ba (A)'),
    ('Revelation of Baruch', 'Rv Ba'),
    ('Barnabas', 'Barn'),
    ('Susannah (Th)', 'Sus (Th)'),
    ('Bel and the dragon (Th)', 'Bel (Th)'),
    ('Tobit (S)', 'Tb (S)'),
    ('Undefined', 'Und.'),
    ('Apocryphal Psalms', 'Ap.Ps'),
    ('Epistle of Baruch (B)', 'Ep Ba (B)'),
    ('1 Maccabees (B)', '1 M (B)'),
    ('Psalm 151 (B)', 'Ps 151 (B)'),
    ('Tobit (B)', 'Tb (B)'),
    ('Prayer of Manasseh (B)', 'Man (B)'),
]

# Further names of books.
ALIASES = [
    ('1Co', '1 Corinthians'),
    ('2Co', '2 Corinthians'),
    ('1Jn', '1 John'),
    ('2Jn', '2 John'),
    ('1P', '1 Peter'),
    ('2P', '2 Peter'),
    ('1Th', '1 Thessalonians'),
    ('2Th', '2 Thessalonians'),
    ('2Tm', '2 Timothy'),
    ('He', 'Hebrews'),
    ('Ja', 'James'),
    ('Jn', 'John'),
    ('Lk', 'Luke'),
    ('Mk', 'Mark'),
    ('Mt', 'Matthew'),
    ('Ac', 'Acts'),
    ('Ep', 'Ephesians'),
    ('Ga', 'Galatians'),
    ('Re', 'Revelation'),
    ('Ro', 'Romans'),
    ('1 Thessalonicians', '1 Thessalonians'),
    ('2 Thessalonicians', '2 Thessalonians'),
    ('Tite', 'Titus'),
]

# Markup labels, applied in this order.
LABELS = [
    ("citationExacte", "Quotation"),
    ("citationScripturaire", "Quotation"),
    ("citationInexacte", "inexactQuotation"),
    ("inextQuotation", "inexactQuotation"),
    ("inexctQuotation", "inexactQuotation"),
    ("inexactQuotattion", "inexactQuotation"),
    ("refScripturaire", "biblicalRef"),
    ("inexactQuotation - lemme", "inexactQuotation"),
    ("lemma", "Quotation"),
    ("quotation", "Quotation"),
    ('part="N"', ""),
]

# Opening tags whose content is a reference, as they may be written and as they are written anew, in this order.
REFERENCE_TAGS = [
    (r'<seg\s*ana="allusion"\s*type="biblicalRef"\s*>', '<seg ana="allusion" type="biblicalRef">'),
    (r'<seg\s*type="biblicalRef"\s*ana="allusion"\s*>', '<seg type="biblicalRef" ana="allusion">'),
    (r'<seg\s*ana="Quotation"\s*type="biblicalRef"\s*>', '<seg ana="Quotation" type="biblicalRef">'),
    (r'<seg\s*type="biblicalRef"\s*ana="Quotation"\s*>', '<seg type="biblicalRef" ana="Quotation">'),
    (r'<seg\s*ana="inexactQuotation"\s*type="biblicalRef"\s*>', '<seg ana="inexactQuotation" type="biblicalRef">'),
    (r'<seg\s*type="biblicalRef"\s*ana="inexactQuotation"\s*>', '<seg type="biblicalRef" ana="inexactQuotation">'),
    (r'<seg\s*ana="Occurrence"\s*type="biblicalRef"\s*>', '<seg ana="Occurrence" type="biblicalRef">'),
    (r'<p\s*rend="footnote\s*text"\s*>', '<p rend="footnote text">'),
]

# A well-formed reference; rewrites of signs and of accents, in this order.
REFERENCE = r"[1-3]?\s?[A-Za-z]+\s+\d{1,3}:\d{1,3}(?:\.\d{1,3})*(?:-\d{1,3})?"
SIGNS = [("et", ";"), ("_", " "), (",", ":"), ("--", "-")]
ACCENTS = [("Ép", "Ep"), ("Éz", "Ez"), ("Co ", "Col ")]

# Elements whose content is no text, and what is rewritten in TEI files before parsing, in this order.
SKIPPED = {"note", "ref", "rdg", "teiHeader", "standOff"}
CLEANUP = [
    (r'(?s)<seg type="modified">(.+?)</seg>', "$1"),
    (r'(?s)<seg type="insertion">(.+?)</seg>', "$1"),
    (r'(?s)<seg type="insertion/modified">(.+?)</seg>', "$1"),
    (r"<c>[^</c>]+</c>", ""),
    (r"&.+?;", ""),
    (r'<seg type="biblicalQuotation">[.,;:!?]</seg>', ""),
    (r'<seg type="biblicalQuotation">[.,;:!?]</seg>', ""),
    (r'<pb\s*break="no"\s*edRef=[\s\S]*?\s*n=[\s\S]*?\s*>\s*</pb\s*>', ""),
    (r'<lb\s*break="no"\s*n=[\s\S]*?\s*>\s*</lb\s*>', ""),
]

# Fixed values: (element, attribute, prefix, values that don't count) of what marks a run of a Word document; texts that an insertion may be long.
MARKS = [("color", "val", "c", {"auto"}), ("highlight", "val", "h", {"none"}), ("shd", "fill", "s", {"auto", "clear"}), ("rStyle", "val", "st", set())]
LOOK_BACK = 500

# Character classes of word cleaning.
NOT_IN_WORDS = r"[^A-Za-zÀ-ÿ\s.,;:!?'\n]"
PUNCTUATION_PAIR = "[.;,·:!?]{2}"

# Sentinels for no reference and no reuse, and the separator of several values.
NO_REF, NO_REUSE, SEPARATOR = "o", "NaR", " ; "

# Sentence boundaries, punctuation tokens, and marks that glue in running text.
BOUNDARIES = [".", "?", "!", ";"]
PUNCTUATION = [".", ",", ";", ":", "!", "?"]
ATTACHED_LEFT = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~»›")
ATTACHED_RIGHT = list("«‹([{")
