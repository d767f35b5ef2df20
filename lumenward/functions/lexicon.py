"""The risk lexicon and its lookup tables, kept as plain data.

Patterns are stored in their ECMAScript form; :mod:`lumenward.functions.dialect`
turns them into the regex dialect Spark runs.  The columns after that are ours
and say what a text must hold for the pattern to match at all, so that the
pattern runs on few texts.  ``words`` is for Latin patterns, which match between
ASCII word boundaries: one of them is in the text as a whole run of ASCII word
characters ("mátate" has the runs "m" and "tate").  ``parts`` is for the other
scripts: the lower-case text contains at least one of them.
"""

from __future__ import annotations

from typing import NamedTuple


class Entry(NamedTuple):
    ord: int
    category: str
    signal: str | None
    lang: str
    weight: float
    pattern: str
    ignore_case: bool
    words: str
    parts: tuple[str, ...] = ()


# Categories with their labels, in reporting order.
CATEGORIES = (
    ("sexual-solicitation", "Sexual solicitation"),
    ("grooming", "Grooming pattern"),
    ("harassment", "Harassment / bullying"),
    ("self-harm", "Self-harm risk"),
    ("violent-threat", "Violent threat"),
)

# Categories whose confidence depends on who the sender is.
STRANGER_CATEGORIES = ("sexual-solicitation", "grooming")
# Category that only counts in the monitored person's own messages.
OUTGOING_ONLY_CATEGORY = "self-harm"

ANY_LANGUAGE = "any"
# English slang turns up in every language, so its entries always apply.
ALWAYS_LANGUAGE = "en"

# Fixed values: (category, signal, language, weight, pattern, ignore-case) in
# matching order.
_ROWS = (
    # sexual solicitation
    ("sexual-solicitation", None, "en", 0.7, r"\b(send|show)\s+(me\s+)?(a\s+)?(pic|pics|picture|photo|photos|nude|nudes|naked)\b", True,
     "pic pics picture photo photos nude nudes naked"),
    ("sexual-solicitation", None, "es", 0.7, r"\b(m[aá]nd(a|ame)|env[ií]ame|ens[eé][ñn]ame)\b.*\b(foto|fotos|desnud[oa]s?)\b", True,
     "foto fotos desnudo desnuda desnudos desnudas"),
    ("sexual-solicitation", None, "fr", 0.7, r"\b(envoie|montre)(-?moi)?\b.*\b(photo|photos|nue?s?)\b", True,
     "envoie envoiemoi montre montremoi"),
    ("sexual-solicitation", None, "pt", 0.7, r"\b(manda|envie|mostra)\b.*\b(foto|fotos|pelad[oa]s?|nu[a]?)\b", True,
     "manda envie mostra"),
    ("sexual-solicitation", None, "de", 0.7, r"\b(schick|zeig)(\s+mir)?\b.*\b(bild|bilder|nackt|nacktbild)\b", True,
     "schick zeig"),
    ("sexual-solicitation", None, "any", 0.55, r"\b(sext|sexting|horny|turn me on)\b", True,
     "sext sexting horny turn"),
    ("sexual-solicitation", None, "ar", 0.7, r"صورة عارية|أرسل لي صورة", False,
     "", ("صورة",)),
    ("sexual-solicitation", None, "ru", 0.7, r"пришли фото|голое фото", True,
     "", ("ф",)),
    # grooming: secrecy
    ("grooming", "secrecy", "en", 0.5, r"\b(don'?t|do not|never)\s+(tell|say (this|it) to|mention (this|it) to)\b[^.!?]*\b(parents?|mom|mum|dad|anyone|family)\b", True,
     "parent parents mom mum dad anyone family"),
    ("grooming", "secrecy", "en", 0.5, r"\b(our|keep (it|this))\s+(little\s+)?secret\b|\bbetween (just )?us\b", True,
     "secret between"),
    ("grooming", "secrecy", "es", 0.5, r"\bno\s+(le\s+)?(digas|cuentes)\b[^.!?]*\b(padres|mam[aá]|pap[aá]|nadie)\b|\bnuestro secreto\b", True,
     "digas cuentes secreto"),
    ("grooming", "secrecy", "fr", 0.5, r"\bne\s+(le\s+)?dis\s+(pas|à personne|à tes parents)\b|\bnotre secret\b", True,
     "dis secret"),
    ("grooming", "secrecy", "pt", 0.5, r"\bn[aã]o\s+(conta|fala)\b[^.!?]*\b(pais|m[aã]e|ningu[eé]m)\b|\bnosso segredo\b", True,
     "conta fala segredo"),
    ("grooming", "secrecy", "de", 0.5, r"\b(sag|erz[aä]hl)\s+(es\s+)?(niemandem|deinen eltern)\b|\bunser geheimnis\b", True,
     "niemandem eltern geheimnis"),
    ("grooming", "secrecy", "ar", 0.5, r"لا تخبر والدي?ك|سرنا", False,
     "", ("لا تخبر", "سرنا",)),
    ("grooming", "secrecy", "ru", 0.5, r"никому не говори|наш секрет", True,
     "", ("ник", "наш",)),
    # grooming: moving to another platform
    ("grooming", "platform-move", "any", 0.5, r"\b(add me on|let'?s (talk|chat|move) (on|to)|dm me on|do you have|text me on|hop on)\b[^.!?]*\b(snap(chat)?|telegram|whats?app|kik|discord|signal|wickr|insta(gram)?)\b", True,
     "snap snapchat telegram whatsapp whatapp kik discord signal wickr insta instagram"),
    ("grooming", "platform-move", "any", 0.45, r"\b(pas(a|emos) a|habla?mos por|escr[ií]beme (por|en))\b[^.!?]*\b(snap|telegram|whats?app|kik)\b", True,
     "snap telegram whatsapp whatapp kik"),
    # grooming: meeting
    ("grooming", "meeting", "en", 0.5, r"\b(where do you live|what'?s your address|can we meet|let'?s meet( up)?|meet up|come over|i'?ll pick you up)\b", True,
     "live address meet over pick"),
    ("grooming", "meeting", "es", 0.5, r"\b(d[oó]nde vives|tu direcci[oó]n|podemos vernos|nos vemos|te recojo|ven a)\b", True,
     "vives direccion direcci vernos vemos recojo ven"),
    ("grooming", "meeting", "fr", 0.5, r"\b(o[uù] habites[- ]tu|ton adresse|on se voit|je viens te chercher)\b", True,
     "habites adresse voit chercher"),
    ("grooming", "meeting", "pt", 0.5, r"\b(onde voc[eê] mora|seu endere[çc]o|a gente se v[eê]|te busco)\b", True,
     "mora endereco endere gente busco"),
    ("grooming", "meeting", "de", 0.5, r"\b(wo wohnst du|deine adresse|treffen wir uns|ich hole dich ab)\b", True,
     "wohnst adresse treffen hole"),
    # grooming: probing age or being alone
    ("grooming", "age-probe", "en", 0.45, r"\b(how old are you|are your parents (home|around|there)|are you (home )?alone)\b", True,
     "old parents alone"),
    ("grooming", "age-probe", "es", 0.45, r"\b(cu[aá]ntos a[nñ]os tienes|est[aá]n tus padres|est[aá]s sol[oa])\b", True,
     "tienes padres solo sola"),
    ("grooming", "age-probe", "fr", 0.45, r"\b(quel [aâ]ge as[- ]tu|tes parents sont[- ]l[aà]|tu es seul)\b", True,
     "quel parents seul"),
    ("grooming", "age-probe", "pt", 0.45, r"\b(quantos anos voc[eê] tem|seus pais est[aã]o|voc[eê] est[aá] sozinh)\b", True,
     "quantos pais sozinh"),
    ("grooming", "age-probe", "de", 0.45, r"\b(wie alt bist du|sind deine eltern (da|zuhause)|bist du allein)\b", True,
     "alt eltern allein"),
    # grooming: flattery
    ("grooming", "flattery", "en", 0.4, r"\b(you'?re so mature|mature for your age|you'?re (so )?different|you'?re not like other|our little)\b", True,
     "mature different other little"),
    ("grooming", "flattery", "es", 0.4, r"\b(muy madura? para tu edad|eres diferente|no eres como)\b", True,
     "edad diferente eres"),
    # grooming: enticement
    ("grooming", "enticement", "en", 0.5, r"\b((i('| ha)ve got|i('ll| will)? (get|bring|give|hook you up with))\s+(you\s+)?(some\s+)?|(do you want|you want|want|wanna|try)\s+(some\s+)?)(drugs?|weed|marijuana|pills?|molly|coke|cocaine|heroin(e)?|meth|ecstasy|mdma|xanax|fentanyl|vape|alcohol|beer|wine|liquor)\b|\b(free|some)\s+(weed|drugs?|alcohol|pills?|heroin(e)?)\s+for\s+you\b", True,
     "drug drugs weed marijuana pill pills molly coke cocaine heroin heroine meth ecstasy mdma xanax fentanyl vape alcohol beer wine liquor"),
    ("grooming", "enticement", "es", 0.5, r"\b(tengo|te consigo|te doy|te traigo)\s+(droga|drogas|marihuana|pastillas|alcohol|cerveza)\b", True,
     "droga drogas marihuana pastillas alcohol cerveza"),
    ("grooming", "enticement", "fr", 0.5, r"\b(j'ai|je peux (t')?avoir|je t'apporte)\s+(de la |des )?(drogue|herbe|alcool|bi[eè]re)\b", True,
     "drogue herbe alcool biere bi"),
    ("grooming", "enticement", "pt", 0.5, r"\b(eu tenho|consigo|posso arranjar|te trago)\s+(droga|maconha|[aá]lcool|cerveja)\b", True,
     "droga maconha alcool lcool cerveja"),
    ("grooming", "enticement", "de", 0.5, r"\b(ich habe|ich besorge dir|ich bring dir)\s+(drogen|gras|alkohol|bier)\b", True,
     "drogen gras alkohol bier"),
    # harassment
    ("harassment", None, "en", 0.5, r"\b(loser|freak|ugly|stupid|worthless|pathetic|nobody likes you|no one likes you|kill yourself|kys)\b", True,
     "loser freak ugly stupid worthless pathetic likes yourself kys"),
    ("harassment", None, "es", 0.5, r"\b(perdedor|fe[oa]|est[uú]pid[oa]|in[uú]til|nadie te quiere|m[aá]tate)\b", True,
     "perdedor feo fea estupido estupida pido pida inutil til quiere matate tate"),
    ("harassment", None, "fr", 0.5, r"\b(rat[eé]|moche|stupide|nul|personne ne t'?aime|tue-toi)\b", True,
     "rate rat moche stupide nul personne tue"),
    ("harassment", None, "pt", 0.5, r"\b(perdedor|fei[oa]|burr[oa]|in[uú]til|ningu[eé]m gosta de voc[eê]|se mata)\b", True,
     "perdedor feio feia burro burra inutil til gosta mata"),
    ("harassment", None, "de", 0.5, r"\b(loser|h[aä]sslich|dumm|wertlos|keiner mag dich|bring dich um)\b", True,
     "loser hasslich sslich dumm wertlos keiner bring"),
    # self-harm
    ("self-harm", None, "en", 0.72, r"\b(i\s+(want|wanna)\s+to?\s+(die|kill myself)|i can'?t go on|no reason to live|end it all|i'?ve been cutting|hurt(ing)? myself|i want to disappear)\b", True,
     "want wanna go reason end cutting myself"),
    ("self-harm", None, "es", 0.72, r"\b(quiero (morir(me)?|matarme)|no puedo m[aá]s|no vale la pena vivir|me hago da[nñ]o|me corto)\b", True,
     "morir morirme matarme puedo vivir hago corto"),
    ("self-harm", None, "fr", 0.72, r"\b(je veux mourir|je veux me tuer|je n'?en peux plus|me faire du mal|je me coupe)\b", True,
     "mourir tuer peux mal coupe"),
    ("self-harm", None, "pt", 0.72, r"\b(quero morrer|quero me matar|n[aã]o aguento mais|me machuco|me corto)\b", True,
     "morrer matar aguento machuco corto"),
    ("self-harm", None, "de", 0.72, r"\b(ich will sterben|ich will mich umbringen|ich kann nicht mehr|mich verletzen|ritze mich)\b", True,
     "sterben umbringen mehr verletzen ritze"),
    ("self-harm", None, "ar", 0.72, r"أريد أن أموت|أريد قتل نفسي|أؤذي نفسي", False,
     "", ("أريد", "أؤذي",)),
    ("self-harm", None, "ru", 0.72, r"хочу умереть|убить себя|режу себя", True,
     "", ("умере", "уби", "режу",)),
    ("self-harm", None, "hi", 0.72, r"मैं मरना चाहता|मरना चाहती|खुद को नुकसान", False,
     "", ("मरना", "खुद",)),
    # violent threats
    ("violent-threat", None, "en", 0.72, r"\b((i'?m (going to|gonna)|imma|ima)\s+(kill|hurt|beat)\s+(you|u|ya)(\s+up)?|i'?ll (kill|hurt|beat)\s+(you|u|ya)(\s+up)?|i will (kill|hurt|beat)\s+(you|u|ya)(\s+up)?|bring a (gun|knife)|shoot up|(you'?re|ur) dead)\b", True,
     "kill hurt beat gun knife shoot dead"),
    ("violent-threat", None, "es", 0.72, r"\b(te voy a (matar|hacer da[nñ]o|golpear)|te mato|voy a llevar (una pistola|un cuchillo))\b", True,
     "matar hacer golpear mato llevar"),
    ("violent-threat", None, "fr", 0.72, r"\b(je vais te (tuer|frapper|faire du mal)|je te tue)\b", True,
     "tuer frapper faire tue"),
    ("violent-threat", None, "pt", 0.72, r"\b(vou te (matar|machucar|bater)|te mato)\b", True,
     "matar machucar bater mato"),
    ("violent-threat", None, "de", 0.72, r"\b(ich (werde|bring) dich um|ich schlag dich (zusammen|tot))\b", True,
     "werde bring schlag"),
)

ENTRIES = tuple(Entry(i, *row) for i, row in enumerate(_ROWS))
