"""The ten sample messages and what they give."""

# The sample messages, and below what they come to.
SAMPLE = [
    dict(id="m1", text="hey you're so mature for your age, don't tell your parents about this. let's talk on telegram instead",
         direction="incoming", senderRelationship="not-mutual", platform="instagram", source="android-accessibility"),
    dict(id="m2", text="mándame unas fotos desnuda y no le digas a nadie",
         direction="incoming", senderRelationship="not-mutual", platform="instagram", source="android-accessibility"),
    dict(id="m3", text="i can't go on anymore, i just want to disappear",
         direction="outgoing", senderRelationship="unknown", platform="whatsapp", source="family-link"),
    dict(id="m4", text="ich kann nicht mehr, alles ist sinnlos",
         direction="outgoing", senderRelationship="unknown", platform="whatsapp", source="family-link"),
    dict(id="m5", text="i'm going to hurt you after school tomorrow",
         direction="incoming", senderRelationship="mutual", platform="instagram", source="android-accessibility"),
    dict(id="m6", text="ninguém gosta de você, perdedor",
         direction="incoming", senderRelationship="mutual", platform="tiktok", source="android-accessibility"),
    dict(id="m7", text="on se voit ce weekend, tu es seul chez toi?",
         direction="incoming", senderRelationship="not-mutual", platform="instagram", source="android-accessibility"),
    dict(id="m8", text="لا تخبر والديك عن حديثنا",
         direction="incoming", senderRelationship="not-mutual", platform="instagram", source="android-accessibility"),
    dict(id="m9", text="want to study for the math test tomorrow after practice?",
         direction="incoming", senderRelationship="mutual", platform="imessage", source="device-notification"),
    dict(id="m10", text="vamos al cine el sábado con el grupo",
         direction="outgoing", senderRelationship="mutual", platform="whatsapp", source="family-link"),
]

# id: language, name, confidence
LANGUAGES = {
    "m1": ("en", "English", 0.95), "m2": ("es", "Spanish", 0.70), "m3": ("en", "English", 0.93),
    "m4": ("de", "German", 0.95), "m5": ("en", "English", 0.95), "m6": ("pt", "Portuguese", 0.95),
    "m7": ("fr", "French", 0.95), "m8": ("ar", "Arabic", 0.95), "m9": ("en", "English", 0.95),
    "m10": ("es", "Spanish", 0.95),
}

# id, rank, category, confidence, language, signals, excerpt
FINDINGS = [
    ("m1", 1, "grooming", 0.88, "en", ["secrecy", "platform-move", "flattery"], "hey ▇▇▇ for your age, don't t…"),
    ("m2", 1, "sexual-solicitation", 0.76, "es", [], "▇▇▇ y no le digas a nadie"),
    ("m2", 2, "grooming", 0.60, "es", ["secrecy"], "… unas fotos desnuda y ▇▇▇"),
    ("m3", 1, "self-harm", 0.72, "en", [], "▇▇▇ anymore, i just want …"),
    ("m4", 1, "self-harm", 0.72, "de", [], "▇▇▇, alles ist sinnlos"),
    ("m5", 1, "violent-threat", 0.72, "en", [], "▇▇▇ after school tomorrow"),
    ("m6", 1, "harassment", 0.50, "pt", [], "…inguém gosta de você, ▇▇▇"),
    ("m7", 1, "grooming", 0.78, "fr", ["meeting", "age-probe"], "▇▇▇ ce weekend, tu es seu…"),
    ("m8", 1, "grooming", 0.60, "ar", ["secrecy"], "▇▇▇ عن حديثنا"),
]
