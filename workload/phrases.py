"""Chat phrases put around the whole texts of the given tables.

The tables hold invented prose that matches almost nothing, so each text gets
one phrase in front and one behind, chosen by its key.
"""

# Fixed values, some of them known sample messages.
PHRASES = (
    # one per lexicon entry, in lexicon order
    "send me a pic", "mándame unas fotos desnuda", "envoie-moi une photo de toi", "manda uma foto pelada",
    "schick mir ein bild", "sextet sext", "أرسل لي صورة", "Пришли фото",
    "please don't tell your parents about this ok", "our little secret", "no le digas a nadie",
    "ne dis pas ça, notre secret", "não conta para os seus pais", "sag es niemandem", "لا تخبر والديك عن حديثنا",
    "никому не говори об этом", "let's talk on telegram instead", "escríbeme por whatsapp",
    "what's your address?", "¿dónde vives?", "on se voit ce weekend", "onde você mora", "wo wohnst du",
    "how old are you", "¿estás sola ahora?", "quel âge as-tu", "quantos anos você tem", "bist du allein zuhause",
    "hey you're so mature for your age", "eres diferente a las otras", "do you want some heroine?",
    "te traigo cerveza", "j'ai de la bière", "eu tenho maconha", "ich besorge dir alkohol",
    "you're a worthless loser", "eres un perdedor", "t'es moche, personne ne t'aime", "ninguém gosta de você, perdedor",
    "loser du bist dumm", "i can't go on anymore, i just want to disappear", "quiero morirme, no puedo más",
    "je veux mourir", "não aguento mais", "ich kann nicht mehr", "أريد أن أموت", "Хочу умереть",
    "मैं मरना चाहता हूँ", "i'm going to hurt you after school tomorrow", "te voy a matar",
    "JE VAIS TE FRAPPER", "vou te bater", "ich schlag dich zusammen",
    # edges
    "i wanna die", "raté va", "tes parents sont là ?", "no digas nada a tu mamá ok", "MÁNDAME una FOTO",
    "add me on snapchat and don't tell anyone", "want to study for the math test tomorrow?",
    "vamos al cine el sábado con el grupo", "kill yourself", "漢字とかな", "send\t me a\n nude", "te mato",
    "i got some drugs for you", "",
)

# Messages without letters, blank ones, scripts beyond those above, and more than one script.
SHORT_TEXTS = (
    " \n\t", "\u00a0\u3000", "123 456!", "😀 👍", "...", "안녕하세요", "こんにちは", "カタカナ", "שלום לך", "สวัสดีครับ",
    "γεια σου", "привет κόσμε", "漢字 한글", "hola שלום", "o a e y", "the", "le la les", "ça où", "per con sono ti",
)
