"""Whether an answer only declines, by the build of its sentences.

A sentence declines if somebody (the speaker, or nobody in a passive) isn't able, allowed or willing to
answer or help, and it says next to nothing else: its words are those of declining, or of the question. It is
a courtesy if it apologises, thanks, refers or offers, and says nothing else. An answer of such
sentences only, one at least declining, is a refusal. A sentence with content of its own makes it an answer,
whatever stands beside; so does a search that found nothing.
"""

from __future__ import annotations

import re

from tracelode.llm.lexicon import Lexicon

SELF, NEG, CAN, SAY, META, DECLINE, POLITE, GLUE = range(8)

_LEXICON = Lexicon({
    "en": {
        SELF: "me my myself we our us mine assistant model ai ourselves",
        NEG: "not no cannot never unable without nothing none neither nor beyond outside against",
        CAN: "can could will would may might shall should must able allowed permitted authori* position comfortable going willing want wish prefer rather need ready like intend possible supposed here free liberty",
        SAY: "answer* respond* reply* help* assist* say* tell* discuss* comment* provid* give* given giving disclos* reveal* share* sharing explain* talk* speak* weigh advis* judg* go* read* do doing that handle* address* support* compl* engage* continue* fulfil* offer* assess* summari* interpret* evaluat* opin* debate* process* review* look* analy* describ* generat* creat* write* confirm* list* compar*",
        META: "case cases question* request* topic* subject* matter* answer* information advice advis* guideline* polic* rule* role remit scope instruction* kind sort issue* point query queries content case file* docket* legal position* purpose* sensitive confidential privacy opinion* parties party task* capacity capabilit* expertise knowledge",
        DECLINE: "decline* refus* pass violat* inappropriate unwilling abstain refrain unsupported prohibit* forbid* forbidden breach* conflict* restrict* supported appropriate",
        POLITE: "sorry apolog* unfortunately regret* regrettably afraid thank* thanks understand* please consult* hope qualified advis* lawyer* professional* expert* else different elsewhere feel contact* seek other another instead appreciate glad happy else welcome patience specialist* attorney* counsel",
        GLUE: "a an the this that these those it its is are was were be been being am have has had having to of in on at for from by with or and but so as if you your any some something anything what who which how there here up about into out own between beyond more less very really just however though although because since do does did don doesn didn won wouldn couldn shouldn isn aren wasn can ll re ve am to would let find way extend* through over one ones yourself would know ask* anyone falls fall lies lie make such at time now today all open respectfully politely kindly simply whatever try trying still",
    },
    "de": {
        SELF: "ich mir mich mein* wir uns unser* assistent* modell sprachmodell ki",
        NEG: "nicht nichts kein* nie niemals weder ohne außerhalb gegen",
        CAN: "kann kannst können könnte* darf dürfen dürfte möchte* will wollen werde werden wird muss müssen soll sollen würde* mag lage imstande befugt gestattet erlaubt möglich berechtigt bereit untersagt",
        SAY: "beantwort* antwort* helf* hilfe weiterhelf* äußer* sagen sprech* auskunft auskünfte geben gebe mitteil* kommentier* erklär* erteil* unterstütz* festleg* eingeh* beurteil* dienen stellung nehmen nachkommen liefer* weiterführ* bearbeit* vorles* lesen bewert* zusammenfass*",
        META: "frage* anfrage* bitte thema antwort* vorgabe* richtlinie* regel* aufgabe* akte* partei* rechtlich* angelegenheit* punkt dazu hierzu hierauf darauf darüber dabei daran rolle zuständig* sache information* auskunft",
        DECLINE: "ablehn* lehne verweiger* weiger* passen unbeantwortet verstößt verstoß* untersag* verboten verbieten ab unangemessen unzulässig absehen verzicht*",
        POLITE: "leider bedaure* bedauer* leid verständnis bitte wenden fachperson* fachmann anwalt anwält* sonst andere* anders danke* entschuldig* gern gerne stellen stell hoffe wünsch* verzeihung bitten",
        GLUE: "der die das den dem des ein eine einen einer einem eines ist sind war sie ihnen ihr ihre ihrer es zu zum zur von vom in im auf an am für mit und oder aber als um so diese dieser dieses diesen solche solchen art davon was wer wie daher deshalb hier jetzt etwas noch auch tun tut über bei nach gehört zählt liegt bleibt da daher bin bist hat habe haben seite selbst sich weil denn",
    },
    "fr": {
        SELF: "je moi mon ma mes nous notre nos assistant* modèle ia",
        NEG: "ne pas aucun* jamais rien sans hors ni non contre contraire*",
        CAN: "peux puis pouvons suis sommes saurais souhaite veux vais voudrais pourrais dois devons préfère préférerais autorisé* habilité* mesure permis possible impossible capable libre droit peut serai sera refuserai",
        SAY: "répond* réponse* aide* aider dire parler commenter prononcer expliquer fournir donner donnée discuter traiter conseiller juger lire accéder communiquer divulguer aborder assister évaluer résumer analyser",
        META: "question* demande* sujet point dossier* consigne* règle* directive* cadre rôle mandat genre sorte information* parties affaire* juridique* compétence* réponse* attribution* politique*",
        DECLINE: "décline* refuse* passe* dépasse* contrevien* enfrein* interdi* impossible inappropri* abstenir abstien* viol* relève* sors sort",
        POLITE: "désolé* malheureusement excuse* regret* merci veuillez consulter consultez conseiller* qualifié* compréhension comprendre autre* adresse* avocat* professionnel* prie hélas navré* pardon espère volontiers",
        GLUE: "le la les un une des du de au aux ce cet cette ces cela ça vous votre vos est sont été être ai avoir pour par dans sur avec et ou mais que qui quoi dont en se il elle on là dessus très plus moins tel telle ici ceci entre sans comme tant puis chose tout toute faire fait",
    },
    "es": {
        SELF: "puedo debo prefiero quiero deseo voy estoy tengo podría responderé contestaré yo mi mis me nosotros nuestro* nuestra* conmigo mí asistente modelo ia",
        NEG: "no ni nunca ningún ninguna nada sin fuera contra contrario",
        CAN: "puedo podría podemos debo debemos voy estoy quiero deseo prefiero tengo he posible corresponde permitid* autorizad* condiciones capaz queda puede dispuest* imposible seré será libertad",
        SAY: "respond* respuesta* ayud* decir hablar coment* pronunciar* explicar dar dará darse facilitar asesor* opinar juzgar leer discutir tratar contestar* proporcionar ofrecer revelar compartir atender entrar resumir",
        META: "pregunta* petición peticiones consulta* solicitud* tema* asunto* expediente* norma* pauta* directri* regla* cometido ámbito alcance función funciones tipo parte* información punto legal* respuesta* papel rol",
        DECLINE: "rechaz* declin* rehus* neg* niego abstener* abstengo va viola* incumpl* prohib* inapropiad* excede* pasar paso",
        POLITE: "siento lamento lamentablemente disculpa* perdón perdone gracias comprensión comprenda consulte asesor* cualificad* otra* otro* abogad* profesional* favor desgracia espero entienda pido desafortunadamente dirígase",
        GLUE: "el la los las un una unos unas del de al a en este esta esto ese esa eso su sus usted le lo es son está están ha haber ser sido se por para con y o que qué cosa cuenta vía tendrá averiguar* algo como cual muy más menos entre sobre al aquí pero ello hacer respecto",
    },
    "it": {
        SELF: "posso voglio devo preferisco io mi mio mia miei mie noi nostro", NEG: "non nessun* niente senza", CAN: "posso possiamo voglio devo desidero autorizzat* grado possibile preferisco", SAY: "rispond* risposta aiut* dire parlare commentare fornire dare discutere",
        META: "domanda richiesta argomento questione linee regole ruolo informazion*", DECLINE: "rifiut* declin* contrario", POLITE: "dispiace spiacente purtroppo grazie scus* consult* avvocato", GLUE: "il lo la gli le un una di del della da in su per con che questo questa quest ma è sono essere a tale",
    },
    "pt": {
        SELF: "posso quero devo prefiro eu meu minha meus minhas nós", NEG: "não nenhum* nada sem", CAN: "posso podemos devo quero vou estou autorizad* possível prefiro", SAY: "respond* resposta ajud* dizer falar comentar fornecer dar discutir",
        META: "pergunta pedido assunto questão regras diretrizes papel informaç*", DECLINE: "recus* declin*", POLITE: "desculp* infelizmente lamento obrigad* consult* advogado", GLUE: "um uma de do da em no na por para com que este esta esse essa isso mas é são ser sobre",
    },
    "nl": {
        SELF: "ik mij mijn wij ons", NEG: "niet niets geen zonder", CAN: "kan kunnen mag wil zal moet toegestaan bevoegd mogelijk", SAY: "antwoord* beantwoord* help* zeggen spreken geven bespreken ingaan uitspreken",
        META: "vraag verzoek onderwerp regels richtlijnen rol informatie dit", DECLINE: "weiger* afwijz*", POLITE: "sorry helaas spijt excuses dank begrip raadpleeg advocaat", GLUE: "de het een is zijn op in voor van aan met die deze dat daar daarop hierop om te u uw maar over",
    },
})
_WORD = re.compile(r"[^\W\d_]+")
#: A search that found nothing is an answer.
_SOUGHT = re.compile(r"\b(?:(?:can ?not|could not|did not|do not|unable to) (?:find|see|locate|identify)|(?:finde|sehe|fand) ich|ich (?:finde|sehe|fand)|ne (?:trouve|vois)|n'ai (?:pas )?trouv\w*|no (?:encuentro|veo|he encontrado|encontré|figura))\b(?! that out)")
#: Words that turn to something or somebody else in place of an answer.
_TURNS = {"averiguarlo", "averiguar", "herausfinden", "elsewhere", "instead", "stattdessen", "plutôt", "invece", "liever"}
_FIGURE = re.compile(r"\d")


def _plain(text: str) -> str:
    return text.lower().replace("’", "'").replace("can't", "can not").replace("won't", "will not").replace("n't", " not").replace("i'd", "i would").replace("i'm", "i am")


def _kind(sentence: str, asked: set[str]) -> str | None:
    """``declines``, ``courtesy``, or None for a sentence with something of its own to say."""
    low = _plain(sentence)
    words = _WORD.findall(low)
    if not words:
        return "courtesy"
    has: set[int] = set()
    own = 0
    for w in words:
        parts = _LEXICON.parts(w)
        has |= parts
        own += len(w) > 1 and not parts and w not in asked
    if own * 6 > len(words) or _FIGURE.search(low) or _SOUGHT.search(low):
        return None
    speaker = SELF in has or "i" in words
    negated = NEG in has and (CAN in has or SAY in has or META in has)
    if (speaker or META in has or "you" in words) and (DECLINE in has and (META in has or SAY in has or CAN in has or speaker) or negated and (SAY in has or META in has or speaker and CAN in has)):
        return "declines"
    if own == 0 and _TURNS.intersection(words):
        return "declines"
    if POLITE in has and own == 0:
        return "courtesy"
    # A turn to another subject, or to the asker's own devices.
    return "courtesy" if own == 0 and (speaker or "you" in words or "usted" in words or "sie" in words or "vous" in words) else None


def refuses(sentences: list[str], question: str | None) -> bool:
    """Whether all sentences decline or are courtesies, and one at least declines."""
    asked = set(_WORD.findall(_plain(question or "")))
    declined = False
    for s in sentences:
        kind = _kind(s, asked)
        if kind is None:
            return False
        declined |= kind == "declines"
    return declined
