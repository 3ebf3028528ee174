"""Pairs that are not from the test tables: question, answer, finish reason, and the defect (None for a sound pair).

FIRST was written before the rules had seen anything but the tables, and then used to mend them; SECOND was written after
that and has changed nothing.
"""

Q = "Who signed the delivery slip for the copper coils?"
W = "When did the clerk file the answer, and who signed it?"
DE = "Wer hat den Lieferschein für die Kupferrollen unterschrieben?"
FR = "Qui a signé le bon de livraison des bobines de cuivre ?"
ES = "¿Quién firmó el albarán de las bobinas de cobre?"

FIRST = [
    (Q, "That's not something I can help with.", "stop", "refusal"),
    (Q, "I'm not able to answer that.", "stop", "refusal"),
    (Q, "I won't be answering this question.", None, "refusal"),
    (Q, "We do not comment on open cases.", "stop", "refusal"),
    (Q, "Sorry, I can't tell you who signed the delivery slip.", "stop", "refusal"),
    (Q, "As an AI language model, I cannot provide legal advice.", "stop", "refusal"),
    (Q, "I must respectfully decline.", "stop", "refusal"),
    (Q, "This request goes against our policy. Please ask something else.", "stop", "refusal"),
    (Q, "I do not wish to discuss this matter.", "stop", "refusal"),
    (Q, "My guidelines do not allow me to share this information.", "stop", "refusal"),
    (DE, "Darauf werde ich nicht antworten.", "stop", "refusal"),
    (DE, "Das kann ich Ihnen leider nicht sagen.", "stop", "refusal"),
    (DE, "Tut mir leid, dabei darf ich nicht helfen.", "stop", "refusal"),
    (DE, "Ich verweigere die Auskunft zu dieser Frage.", "stop", "refusal"),
    (FR, "Je ne répondrai pas à cette question.", "stop", "refusal"),
    (FR, "Désolé, je ne peux pas vous aider.", "stop", "refusal"),
    (FR, "Je refuse de répondre à cette demande.", None, "refusal"),
    (FR, "Il ne m'est pas possible de vous donner cette information.", "stop", "refusal"),
    (ES, "No responderé a eso.", "stop", "refusal"),
    (ES, "Lo siento, no puedo ayudarle con esta pregunta.", "stop", "refusal"),
    (ES, "No me está permitido comentar este asunto.", "stop", "refusal"),
    (ES, "Prefiero no contestar.", "stop", "refusal"),
    ("Chi ha firmato la bolla?", "Mi dispiace, non posso rispondere a questa domanda.", "stop", "refusal"),
    ("Quem assinou a guia?", "Desculpe, não posso ajudar com esse pedido.", "stop", "refusal"),
    (W, "I can't find a signature, but the clerk filed the answer on 3 May and Miller signed it.", "stop", None),
    (Q, "I cannot say for certain, but the slip bears the name of Anna Miller.", "stop", None),
    (Q, "No signature is visible on the slip.", "stop", None),
    (Q, "The witness refused to answer; the slip was signed by Anna Miller.", "stop", None),
    (Q, "Nobody signed it.", "stop", None),
    (Q, "I found no slip in the visible pages.", "stop", None),
    (Q, "The pages do not name the person who signed.", "stop", None),
    (DE, "Anna Miller unterschrieb ihn, der Zeuge wollte nichts sagen.", "stop", None),
    (FR, "Le témoin ne peut pas répondre, mais le bon porte la signature d'Anna Miller.", "stop", None),
    (ES, "No se sabe quién lo firmó; el testigo se negó a declarar.", "stop", None),
    (W, "The clerk filed", "length", "truncated"),
    (W, "The clerk filed the answer on 3 May, and it was signed by", "stop", "truncated"),
    (W, "The clerk filed the answer on 3 May. Miller signed the second copy because the", None, "truncated"),
    (W, "The answer was filed on 3 May (see page", "stop", "truncated"),
    (W, "The answer was filed on 3 May and \"Miller signed", "length", "truncated"),
    (W, "```\nfiled: 3 May\n", "length", "truncated"),
    (W, "| date | name |\n|-|-|\n| 3 May | Mil", "length", "truncated"),
    (W, "- The clerk filed it on 3 May.\n- Miller signed", "length", "truncated"),
    (DE, "Den Lieferschein hat der Lagermeister am 3. Mai unterschrieben, weil der", "stop", "truncated"),
    (FR, "Le bon de livraison a été signé le 3 mai par le", "length", "truncated"),
    (ES, "El albarán fue firmado el 3 de mayo por el", None, "truncated"),
    (Q, "According to page 14, the slip for the copper coils was signed in the presence of two", "stop", "truncated"),
    (W, "- 3 May\n- Anna Miller", "stop", None),
    (W, "1. 3 May\n2. Anna Miller", "stop", None),
    (W, "3 May, Anna Miller", "stop", None),
    (Q, "Anna Miller", "stop", None),
    (Q, "Anna Miller (page: 14)", "stop", None),
    ("What is the address of the depot?", "14 Mill Street\nGenoa", "stop", None),
    ("How many coils were there?", "1,204", "stop", None),
    ("How much was paid?", "EUR 4,500.00", "stop", None),
    ("Was it signed?", "Yes", "stop", None),
    ("Which dockets?", "AZ-2019-LG-K-385", "stop", None),
    ("Which dockets?", "* AZ-2019-LG-K-385\n* AZ-2020-LG-K-12\n* AZ-2021-LG-K-7", "stop", None),
    (W, "| date | name |\n|-|-|\n| 3 May | Miller |", "stop", None),
    (W, "```\nfiled: 3 May\n```", "stop", None),
    (W, "The clerk filed the answer on 3 May (page: 4).", "length", None),
    (Q, "", "stop", "empty"),
    (Q, " ​\n", "length", "empty"),
    (Q, None, "stop", "empty"),
    (Q, Q, "stop", "copy"),
    (Q, "Who signed the delivery slip for the copper coils", "stop", "copy"),
    (Q, "You asked: who signed the delivery slip for the copper coils?", "stop", "copy"),
    (Q, "Who singed the delivery slip for the coper coils?", "stop", "copy"),
    (DE, "Frage: Wer hat den Lieferschein für die Kupferrollen unterschrieben?", "stop", "copy"),
    (FR, "« Qui a signé le bon de livraison des bobines de cuivre ? »", "stop", "copy"),
    (ES, "QUIÉN FIRMÓ EL ALBARÁN DE LAS BOBINAS DE COBRE", "stop", "copy"),
    (Q, "Who signed the delivery slip for the copper coils? Anna Miller did, on 3 May, in the upper shed.", "stop", None),
    (Q, "The delivery slip for the copper coils was signed by Anna Miller.", "stop", None),
    (Q, "De vrachtbrief voor de koperen rollen werd door Anna Miller getekend op de derde mei.", "stop", "language"),
    (Q, "La bolla di consegna è stata firmata da Anna Miller il tre maggio, come risulta dalla pagina.", "stop", "language"),
    (Q, "A guia de entrega foi assinada por Anna Miller no dia três de maio, com a presença do chefe.", "stop", "language"),
    (Q, "Der Lieferschein wurde von Anna Miller am dritten Mai unterschrieben.", "stop", "language"),
    (Q, "Le bon de livraison a été signé par Anna Miller le trois mai.", "stop", "language"),
    (Q, "El albarán fue firmado por Anna Miller el tres de mayo.", "stop", "language"),
    (Q, "Накладную подписала Анна Миллер третьего мая.", "stop", "language"),
    (Q, "提货单由安娜·米勒签署。", "stop", "language"),
    (DE, "The delivery slip was signed by Anna Miller on the third of May.", "stop", "language"),
    (FR, "The delivery slip was signed by Anna Miller on the third of May.", "stop", "language"),
    (ES, "The delivery slip was signed by Anna Miller on the third of May.", "stop", "language"),
    ("Who signed the slip? Please answer in German.", "Anna Miller hat den Lieferschein am dritten Mai unterschrieben.", "stop", None),
    ("Translate into French: the slip was signed.", "Le bon de livraison a été signé par la gérante.", "stop", None),
    ("Antworten Sie bitte auf Englisch: Wer hat unterschrieben?", "It was signed by Anna Miller on the third of May.", "stop", None),
    (Q, "The slip reads « signé par Anna Miller le trois mai » and bears her stamp.", "stop", None),
    (DE, "Anna Miller hat ihn am 3. Mai unterschrieben.", "stop", None),
    (FR, "Anna Miller l'a signé le 3 mai.", "stop", None),
    (ES, "Lo firmó Anna Miller el 3 de mayo.", "stop", None),
]

SECOND = [
    (Q, "I'm afraid that is outside my remit.", "stop", "refusal"),
    (Q, "I am not permitted to disclose this.", "stop", "refusal"),
    (Q, "I cannot assist you with questions about signatures.", "stop", "refusal"),
    (Q, "This falls beyond what I may discuss. Please contact a lawyer.", "stop", "refusal"),
    (Q, "No comment.", "stop", "refusal"),
    (DE, "Dazu möchte ich mich nicht äußern.", "stop", "refusal"),
    (DE, "Diese Anfrage muss ich ablehnen. Bitte wenden Sie sich an einen Anwalt.", "stop", "refusal"),
    (FR, "Je préfère ne pas commenter ce dossier.", "stop", "refusal"),
    (FR, "Cette demande est contraire à mes règles.", "stop", "refusal"),
    (ES, "Esta consulta queda fuera de mi ámbito.", "stop", "refusal"),
    (ES, "Debo rechazar su solicitud.", "stop", "refusal"),
    ("Wie tekende de bon?", "Helaas kan ik deze vraag niet beantwoorden.", "stop", "refusal"),
    (Q, "It cannot be told from the file; the slip is torn where the name would be.", "stop", None),
    (Q, "Sorry for the delay: Anna Miller signed it.", "stop", None),
    (Q, "I do not know, the slip is not among the visible pages.", "stop", None),
    (Q, "The carrier's policy forbids drivers to sign, so the foreman did.", "stop", None),
    (DE, "Der Lagermeister durfte nicht unterschreiben, also tat es Anna Miller.", "stop", None),
    (FR, "Personne n'a signé le bon.", "stop", None),
    (ES, "El albarán no lleva firma.", "stop", None),
    (W, "Miller signed it on 3 May, after the", "stop", "truncated"),
    (W, "On 3 May the clerk filed the answer in the registry and Miller countersigned the second pa", "length", "truncated"),
    (W, "It was filed on 3 May [page: 4, line", None, "truncated"),
    (W, "The dates are:\n- 3 May: filed by the clerk.\n- 4 May: signed by", "length", "truncated"),
    (DE, "Am 3. Mai hat die Lagermeisterin den Schein im oberen Schuppen unterschrieben und", "stop", "truncated"),
    (FR, "Il a été signé par Anna Miller, comme le montre la", None, "truncated"),
    (ES, "Lo firmó Anna Miller en presencia de", "stop", "truncated"),
    ("List the witnesses.", "- Anna Miller\n- Jorge Luna\n- Pierre Vidal", "stop", None),
    ("Which date?", "3 May 2014", "stop", None),
    ("Where was it kept?", "upper shed, bay 4", "stop", None),
    ("What does the label say?", "\"Fragile\"", "stop", None),
    ("Which pages?", "pages 4, 7 and 12", "stop", None),
    (Q, "Signed by: Anna Miller", "stop", None),
    (Q, "who signed the delivery slip, for the copper coils?!", "stop", "copy"),
    (Q, "Question: who signed the delivery slip for the copper coils? Who signed the delivery slip for the copper coils?", "stop", "copy"),
    (FR, "Qui a signé le bon de livraison des bobines de cuivre", "length", "copy"),
    (DE, "Wer hat denn den Lieferschein für die Kupferrollen unterschrieben?", "stop", "copy"),
    (ES, "Usted preguntó: ¿quién firmó el albarán de las bobinas de cobre?", "stop", "copy"),
    (ES, "Las bobinas de cobre: firmó el albarán Anna Miller.", "stop", None),
    (Q, "Följesedeln undertecknades av Anna Miller den tredje maj och hon var ensam på lagret när det hände.", "stop", "language"),
    (Q, "Het was Anna Miller die de bon op drie mei tekende, maar de chauffeur was er niet bij.", "stop", "language"),
    (DE, "È stata Anna Miller che ha firmato la bolla il tre maggio con il capo del deposito.", "stop", "language"),
    (ES, "Ce bon de livraison a été signé par la gérante avec le chauffeur dans le dépôt.", "stop", "language"),
    (Q, "Το δελτίο υπέγραψε η Άννα Μίλερ.", "stop", "language"),
    (FR, "Der Schein wurde von der Lagermeisterin unterschrieben und nicht von dem Fahrer.", "stop", "language"),
    ("Summarise in Spanish who signed the slip.", "El albarán fue firmado por Anna Miller el tres de mayo.", "stop", None),
    (Q, "Anna Miller, as the note \"unterschrieben von der Lagermeisterin\" shows.", "stop", None),
    (DE, "Laut Seite 14 unterschrieb Anna Miller (\"signed by the foreman\" steht darunter).", "stop", None),
    (FR, "C'est Anna Miller qui l'a signé.", "stop", None),
    (Q, " ﻿", None, "empty"),
    (Q, "\n\n\t", "length", "empty"),
]
