"""Held-out pairs: written after the rules and never used to change them. README has the figures of the first run."""

from loam.llm.pairs import defects_of

Q = {
    "en": "How long must the warranty certificate be kept?", "de": "Wie lange muss der Garantieschein aufbewahrt werden?", "fr": "Combien de temps faut-il garder le certificat de garantie ?",
    "es": "¿Cuánto tiempo hay que guardar el certificado de garantía?", "it": "Per quanto tempo si deve conservare il certificato di garanzia?", "pt": "Por quanto tempo o certificado de garantia deve ser guardado?",
    "nl": "Hoe lang moet het garantiebewijs worden bewaard?", "sv": "Hur länge ska garantibeviset sparas?",
}
REFUSALS = {
    "en": [
        "I'm not comfortable giving out that kind of information.", "We are not authorized to discuss individual warranties.", "Sorry, this lies beyond what I'm able to help with.", "I won't get into that.", "I'd prefer not to say anything about it.",
        "My policy does not allow me to respond to this question.", "That's not something I'm willing to comment on.", "I am going to have to decline.", "I regret that I cannot offer any advice on this.", "No comment.", "I have been instructed not to answer questions of this kind.",
        "Unable to comply with this request.", "It would not be appropriate for me to answer.", "I shall not reveal that.",
    ],
    "de": [
        "Dazu möchte ich mich nicht äußern.", "Es tut mir leid, aber dabei kann ich nicht helfen.", "Diese Frage darf ich nicht beantworten.", "Ich muss die Auskunft leider verweigern.", "Ich bin nicht befugt, darüber zu sprechen.", "Das liegt außerhalb meiner Zuständigkeit.",
        "Hierzu gebe ich keine Auskunft.", "Ich lehne es ab, darauf zu antworten.", "Leider ist es mir nicht gestattet, Ihnen das mitzuteilen.", "Darüber darf ich keine Angaben machen.",
    ],
    "fr": [
        "Je ne suis pas autorisé à en parler.", "Désolé, je ne peux pas répondre à cette demande.", "Je préfère ne pas aborder ce sujet.", "Il m'est impossible de vous renseigner là-dessus.", "Je refuse de répondre.", "Cela dépasse mes compétences.", "Je ne suis pas en mesure de vous aider.",
        "Je regrette, mais je ne saurais vous le dire.", "Nous ne pouvons pas communiquer cette information.",
    ],
    "es": [
        "No estoy autorizado a dar esa información.", "Prefiero no opinar sobre eso.", "Lamento no poder ayudarle con esa consulta.", "Me temo que no puedo compartir esos datos.", "Me niego a contestar.", "Eso queda fuera de mis competencias.", "No voy a responder a esa pregunta.", "No se me permite hablar de ello.",
        "Disculpe, pero no debo comentar ese asunto.",
    ],
    "it": ["Mi dispiace, non posso rispondere a questa domanda.", "Preferisco non parlarne.", "Non sono autorizzato a fornire queste informazioni.", "Purtroppo non mi è possibile aiutarla.", "Mi rifiuto di rispondere.", "Questo esula dalle mie competenze."],
    "pt": ["Desculpe, não posso responder a essa pergunta.", "Prefiro não comentar.", "Não estou autorizado a fornecer essa informação.", "Infelizmente não me é possível ajudar.", "Recuso-me a responder.", "Isso está fora das minhas competências."],
    "nl": ["Sorry, daar kan ik geen antwoord op geven.", "Ik mag die informatie niet delen.", "Dat valt buiten mijn bevoegdheid.", "Ik weiger daarop in te gaan.", "Helaas kan ik u hier niet bij helpen.", "Daar zeg ik liever niets over."],
    "sv": ["Tyvärr kan jag inte svara på den frågan.", "Jag får inte lämna ut den uppgiften.", "Det vill jag helst inte kommentera.", "Jag avstår från att svara.", "Den informationen kan jag inte dela.", "Jag är inte behörig att uttala mig."],
}
TRUNCATED = {
    "en": ["Keep the certificate for at least two years after", "The period begins on the day of purchase and ends when the", "You should store it together with the receipt, the serial number and", "Steps:\n\n1. Find the receipt.\n2. Scan it and send it to the", "See the table (column three, under"],
    "de": ["Bewahren Sie den Schein mindestens zwei Jahre nach dem", "Die Frist beginnt mit dem Kauf und endet, sobald der Händler die", "Der Schein gehört zusammen mit der Rechnung in eine Mappe, die", "Beachten Sie, dass der Garantieschein nur dann gilt, wenn er"],
    "fr": ["Gardez le certificat au moins deux ans après la", "Le délai commence le jour de l'achat et se termine quand le vendeur a", "Il faut le conserver avec la facture, le numéro de série et le", "Notez que le certificat n'est valable que si"],
    "es": ["Guarde el certificado al menos dos años después de la", "El plazo empieza el día de la compra y termina cuando el", "Hay que guardarlo con la factura, el número de serie y", "Tenga en cuenta que el certificado solo vale si"],
    "it": ["Conservi il certificato per almeno due anni dopo la data di"], "pt": ["Guarde o certificado por pelo menos dois anos depois da data da"], "nl": ["Bewaar het bewijs minstens twee jaar nadat het product door de"], "sv": ["Spara beviset i minst två år efter att produkten har"],
}
FOREIGN = [
    ("en", "Das Zertifikat ist zwei Jahre lang aufzubewahren. Danach kann es vernichtet werden."), ("en", "Le certificat doit être conservé pendant deux ans."), ("en", "El certificado debe guardarse durante dos años."), ("en", "Il certificato deve essere conservato per due anni."),
    ("en", "O certificado deve ser guardado por dois anos."), ("en", "Het bewijs moet twee jaar worden bewaard."), ("en", "Beviset ska sparas i två år och därefter kan det kastas."), ("en", "Zaświadczenie należy przechowywać przez dwa lata od dnia zakupu."),
    ("en", "Beviset skal gemmes i to år, og derefter kan det smides ud."), ("en", "Sertifika iki yıl boyunca saklanmalıdır ve daha sonra imha edilebilir."), ("en", "Сертификат нужно хранить два года."), ("en", "証明書は二年間保管してください。"), ("en", "证书必须保存两年。"), ("en", "يجب الاحتفاظ بالشهادة لمدة عامين."),
    ("de", "The certificate must be kept for two years."), ("de", "Le certificat doit être conservé pendant deux ans."), ("de", "El certificado debe guardarse durante dos años."), ("de", "Het bewijs moet twee jaar worden bewaard."), ("de", "Zaświadczenie należy przechowywać przez dwa lata od dnia zakupu."),
    ("fr", "The certificate must be kept for two years."), ("fr", "Das Zertifikat ist zwei Jahre lang aufzubewahren."), ("fr", "El certificado debe guardarse durante dos años."), ("fr", "Il certificato deve essere conservato per due anni."), ("fr", "Beviset ska sparas i två år och därefter kan det kastas."),
    ("es", "The certificate must be kept for two years."), ("es", "Das Zertifikat ist zwei Jahre lang aufzubewahren."), ("es", "Le certificat doit être conservé pendant deux ans."), ("es", "O certificado deve ser guardado por dois anos e não pode ser dobrado."), ("es", "A bizonyítványt két évig meg kell őrizni, és csak utána lehet kidobni."),
    ("it", "The certificate must be kept for two years."), ("pt", "The certificate must be kept for two years."), ("nl", "The certificate must be kept for two years."), ("sv", "The certificate must be kept for two years."),
]
SOUND = [
    ("en", "Keep it for two years."), ("en", "Two years."), ("en", "The certificate cannot be replaced, so keep it for two years with the receipt."), ("en", "You may not fold it. Keep it for two years."), ("en", "It is not possible to extend the period; two years is the limit."), ("en", "I would keep it for two years, not longer."),
    ("en", "No. The certificate is valid without a date."), ("en", "We do not ask for it after two years."), ("en", "- two years\n- the receipt\n- the serial number"), ("en", "See section 4 (\"Warranty\")."), ("en", "Run `keep --years 2` and wait."), ("en", "The Italian text says «Il certificato», that is, two years apply."),
    ("en", "Our office is outside the city; the certificate stays valid for two years."), ("en", "Nobody but you can answer for the seal, but two years are enough."),
    ("de", "Zwei Jahre lang."), ("de", "Bewahren Sie ihn zwei Jahre auf; ein Ersatz ist nicht möglich."), ("de", "Der Händler kann ohne den Schein keine Auskunft über die Garantie geben, daher gilt eine Frist von zwei Jahren."), ("de", "Nein, das ist nicht nötig."), ("de", "Ohne Rechnung gilt der Schein nicht."), ("de", "Ich würde ihn zwei Jahre aufbewahren."),
    ("fr", "Deux ans."), ("fr", "Il faut le garder deux ans, sans le plier."), ("fr", "Le vendeur ne peut pas fournir de copie ; gardez-le deux ans."), ("fr", "Non, ce n'est pas nécessaire."), ("fr", "Je vous conseille de le garder deux ans."),
    ("es", "Dos años."), ("es", "Hay que guardarlo dos años y no se puede doblar."), ("es", "El vendedor no puede dar una copia, así que guárdelo dos años."), ("es", "No, no hace falta."), ("es", "Sin la factura, el certificado no vale."),
    ("it", "Due anni dalla data di acquisto."), ("pt", "Dois anos a partir da compra."), ("nl", "Twee jaar na de aankoop."), ("sv", "Två år efter köpet."), ("sv", "Beviset ska sparas i två år."),
]


def share(pairs: list[tuple[str, str]], defect: str) -> tuple[int, int, list[tuple[str, str]]]:
    missed = [(lang, a) for lang, a in pairs if defect not in defects_of(Q[lang], a)]
    return len(pairs) - len(missed), len(pairs), missed


def figures() -> dict[str, tuple[int, int]]:
    flat = lambda x: [(lang, a) for lang, answers in x.items() for a in answers]
    found = {"refusal": share(flat(REFUSALS), "refusal"), "truncated": share(flat(TRUNCATED), "truncated"), "language": share(FOREIGN, "language")}
    wrong = [(lang, a, d) for lang, a in SOUND if (d := defects_of(Q[lang], a))]
    return {k: v[:2] for k, v in found.items()} | {"sound": (len(SOUND) - len(wrong), len(SOUND))}, {k: v[2] for k, v in found.items()} | {"sound": wrong}


def test_held_out_pairs():
    found, _ = figures()
    assert sum(n for k, (_, n) in found.items() if k != "sound") >= 100
    for kind, (hit, n) in found.items():
        assert hit >= 0.8 * n, (kind, hit, n)
