"""Whether a sentence is a notice of the machine (an error, a call for scripts, filler) by what it consists of.

Every word is looked up in a small lexicon of the words that such notices are made of, each with
its part: what they are about (a page, a server, a session), what befell it, scripts, what the reader shall do,
negations, and glue. A notice has the parts of its kind and next to no word outside the lexicon; a
sentence that speaks of an error has parties, dates, places and acts beside it, which are outside.
No sentence is spelled out, and a word's part doesn't depend on its sentence.
"""

from __future__ import annotations

import re

from tracelode.llm.lexicon import Lexicon

SCRIPT, FAIL, THING, ACT, NOT, SEE, GLUE, FILL, BODY, COME, OFF, GRANT, NET = range(13)

#: The lexicon, by language and part. A star stands for any ending.
_WORDS = {
    "any": {
        SCRIPT: "javascript* ecmascript* js script scripts scripting noscript",
        FAIL: "error* http https timeout* 404",
        THING: "browser* server* portal* link* url* session* internet* web* website* online client* app apps cookie* token gateway* database* proxy firewall* nginx apache cloudflare openresty iis varnish traceback admin* support system* java",
        NET: "browser* server* portal* link* url* session* website* online client* app apps cookie* gateway* database* firewall* nginx apache cloudflare connection* connexion* conexión* conexão verbindung* sitzung* sesión sessão sessione sessie serveur* servidor* navigateur* navegador* enlace* upstream",
        FILL: "lorem ipsum xxx* tbd todo blah bla",
    },
    "en": {
        SCRIPT: "script*",
        FAIL: "unavailable denied corrupt* malformed unsupported suspended deprecated halted stopped aborted rejected declined unresponsive insufficient interrupted disrupted outage downtime forbidden expired refused failed failure* invalid broken wrong missing overloaded busy blocked unauthori* exception* crash* problem* difficult* unexpected* unknown maintenance construction lost reset moved gone oops bad technical internal unreachable inaccessible prohibited fatal exceeded disconnect* toolong timed unable offline",
        THING: "page* site document* folder* image* video* feature* item* query results profile form upload* download* mail* email provider hosting domain operation transaction device credentials user username id file* docket* resource* request* requests service* connect* address* route* content access* network* viewer application* technical upstream host station registry start search homepage home settings side login account password data permission* rights authori* reason*",
        ACT: "enable* activate* allow* ask make ensure verify confirm sign register subscribe accept press clear remember add supply turn* switch* permit* unblock* require* need* must please should use change reload* refresh* try retry contact return go report wait slow install upgrade update check click disable* deactivat*",
        NOT: "not no cannot without never nothing unable couldn can",
        SEE: "find found load* encounter* sent send receiv* save* submit* fetch* retriev* connect* access* use* using handle* perform* deliver* located given get got support* open* reach* display* view* see read* sign log logged continu* work* run* start* process* complete* serve* respond* answer* locate* exist* match* appear* show* proceed render* occur* establish* experienc* persist* followed follow requested looking are available happened went goes took supports support function*",
        GLUE: "a an the this only valid just also all both same new old current currently until because due since while within during once twice sure able via he that these your you our we us i it its is are was were be been being has have had may might could will would to of in on at for from by with or and if so but now again later soon currently temporarily momentarily too many long while off down out up back as here there something some one side more few minutes moment sorry properly correctly when after before then yet still which who noticed ve re s t d ll m doesn does do did don isn wasn aren t nothing first time any other their help over under full bit shortly apologi* inconvenience experience*",
        FILL: "dummy placeholder* sample filler",
        BODY: "text paragraph* copy sentence* content* heading* example* section* description* body article* chapter*",
        COME: "follow* come* coming pending written replace* ignore* soon tba hold* appear* goes added inserted",
        OFF: "disabled off blocked deactivated required enabled activated needed necessary mandatory",
        GRANT: "permission* access authori* rights allowed",
    },
    "de": {
        SCRIPT: "skript*",
        FAIL: "fehler* verweigert* beschädigt* unterbrochen* fehlerhaft* beendet unterbrechung ausfall ausgefallen* abgelehnt* gesperrt* verboten* abgelaufen* ungültig* veraltet* unerreichbar* wartung* störung* problem* überlastet* unbekannt* unerwartet* intern* technisch* kaputt* defekt* schief* zulange verschoben* fehlgeschlagen* abgebrochen* geschlossen* baustelle",
        THING: "seite* dokument* link* bild* video* ordner* formular* nutzer* benutzer* passwort kennwort daten* domain* website webseite server* browser* gerät* feature* vorgang datei* akte* dienst* anfrage* anforderung* sitzung* verbindung* adresse* zugriff* zugang* startseite anwendung* betrachter seitenbetrachter aktenportal netz* berechtigung* rechte* erlaubnis einstellung* inhalt* konto",
        ACT: "aktivier* erlauben erlaube zulassen einschalten einzuschalten schalten benötig* erfordert* braucht muss müssen bitte laden versuchen kontaktieren wenden ändern verwenden",
        NOT: "nicht kein* ohne nie nichts",
        SEE: "gefunden vorhanden gesendet senden speichern gespeichert abgerufen abrufen melden einloggen erlaubt gültig* berechtigt* unterstützen verarbeiten erreichen erreicht hergestellt finden laden angemeldet führen durch geladen verfügbar erreichbar existiert angezeigt geöffnet öffnen lesen sehen anzeigen starten fortfahren anmelden verarbeitet aufgetreten bearbeitet antwortet funktioniert nutzen angeforderte* gewünschte* gesuchte* aufgerufene* unterstützt ausführung",
        GLUE: "dies nur bloß sich an ab aus auch nochmals mehr weil da damit wenn falls wieder wir unseren unsere könnte stehen der die das den dem des ein eine einen einem einer ist sind wird werden wurde war hat haben sie ihr ihre ihren ihrem wir uns unser* es zu zum zur von vom in im auf an am für mit und oder um diese dieser dieses diesen derzeit zurzeit momentan vorübergehend später erneut noch einmal neu wegen leider kann können konnte konnten lang* viele zurück aktives aktive clientseitige entschuldigung aufgrund bei da so etwas gegangen tut leid",
        FILL: "blindtext* beispieltext* platzhalter* mustertext* fülltext*",
        BODY: "blindtext* beispieltext* platzhaltertext* mustertext* fülltext* text* inhalt* absatz beschreibung abschnitt",
        COME: "folgt folgen ergänzt nachgereicht kommt kürze demnächst bald steht erscheint stelle hier dieser",
        GRANT: "berechtigung* rechte zugriff* zugang erlaubnis befugnis zugriffsrechte",
        OFF: "abgeschaltet deaktiviert* ausgeschaltet blockiert* aktiviert erforderlich notwendig nötig eingeschaltet",
    },
    "fr": {
        SCRIPT: "script* langage",
        FAIL: "erreur* introuvable* échoué* échec* interrompu* corrompu* inaccessible* perdu* rejeté* suspendu* endommagé* indisponible* refusé* interdit* expiré* invalide* rompu* périmé* obsolète* maintenance problème* panne difficulté* inattendue* inconnu* technique* interne* mort* cassé* déplacé* fermé* bloqué* impossible surchargé* travaux construction désolé*",
        THING: "page* site* document* image* vidéo* formulaire* utilisateur* compte* mot passe données domaine opération fichier* dossier* service* serveur* requête* demande* connexion* adresse* accès autorisation droit* accueil visionneuse application* navigateur* lien* portail* réseau* ressource* paramètre* identifiant* contenu*",
        ACT: "activ* autoris* débloqu* nécessit* requi* exig* besoin veuillez réessay* reconnect* rechargez recharger utilisez contactez modifiez doit devez merci",
        NOT: "pas ne n sans aucun* non jamais rien",
        SEE: "trouvée trouvé autorisé* accepte accepter prend charge envoyé envoyer enregistrer ouvrir accéder permis valide valides rencontré établi établie utiliser existe disponible accessible charger lire voir afficher consulter démarrer continuer répond répondre traitée traité survenue survenu produite produit exécute fonctionne demandée demandé recherchée recherché aboutie suivi peut peuvent pu",
        GLUE: "le la les êtes suis avons où si dont afin tous toutes seulement lors nouveau encore instant l un une des du de d à au aux ce cet cette ces votre vos vous nous notre nos est sont a ont été être être pour par dans sur avec et ou que qui s c se il elle en y plus tard avez avons actuellement momentanément temporairement trop nombreuses retour puis afin temps mis quelque chose passé mal y veuillez",
        FILL: "factice* faux remplissage exemple*",
        BODY: "texte* contenu* paragraphe* rubrique* description*",
        COME: "venir suivre compléter provisoire* remplacer ici figurera prochainement bientôt ceci viendra",
        GRANT: "accès autorisation* droit droits autorisé*",
        OFF: "désactivé* activé* requis* nécessaire* indispensable*",
    },
    "es": {
        SCRIPT: "guiones comandos secuencias lenguaje",
        FAIL: "denegad* interrumpid* dañad* rechazad* suspendid* inaccesible* incorrect* inválido inválida prohibid* caducad* expirad* inválid* rot* obsolet* mantenimiento problema* fallo* falló inesperad* desconocid* intern* técnic* movid* cerrad* bloquead* mal saturad* construcción imposible dificultades sobrecargad* siento sentimos",
        THING: "página* sitio* imagen* vídeo* video* formulario* usuario* cuenta* contraseña datos dominio operación documento* archivo* expediente* servicio* servidor* solicitud* petición* peticiones conexión* dirección acceso* permiso* autorización derechos inicio visor aplicación* navegador* enlace* sesión* red recurso* ajustes contenido*",
        ACT: "active activar habilite habilitar permita permitir desbloquee necesita* requiere* exige* debe favor inténtelo intente recargue vuelva volver entrar contacte use cambie",
        NOT: "no sin ningún ninguna nunca nada",
        SEE: "existe ocurrido autorizad* enviar enviado guardar acceder válid* recibido ejecución usar utilizar conectar permite soporta admite compatible ocurrió encontrad* encuentra encontró disponible* accesible* cargar leer ver abrir mostrar continuar iniciarse iniciar responde responder procesar producido produjo pudo puede podido existe funciona ejecute ejecuta solicitada solicitado buscada siguió tardó tiene completar salido",
        GLUE: "el la los las un una del de al a en este esta esto ese esa su sus usted nuestro nuestra es son está están ha han se por para con y o que lo le más tarde nuevo momento actualmente temporalmente demasiad* antes luego después debido algo ido en vuelve",
        FILL: "relleno ficticio* simulado* muestra prueba ejemplo*",
        BODY: "texto* contenido* párrafo* descripción*",
        COME: "pendiente* venir próximamente aquí provisional* continuación seguirá figurará aparecerá breve pronto sustituir reemplazar",
        GRANT: "permiso* acceso autorización autorizad* derechos",
        OFF: "deshabilitad* desactivad* activad* necesari* obligatori* habilitad* requerid*",
    },
    "it": {
        FAIL: "errore errori fallito fallita negata rifiutata inaccessibile sospeso negato vietato scaduta scaduto disponibile manutenzione problema imprevisto inatteso interrotto rotto", THING: "pagina sito documento file servizio richiesta connessione indirizzo accesso autorizzazione sessione collegamento navigatore applicazione",
        ACT: "abilita abilitare attiva attivare attivi richiede necessario serve deve prego riprova riprovi ricarica ricaricare consenti", NOT: "non senza nessun", SEE: "trovata trovato caricare valido valida valide accedere aprire esiste inviare supporta visualizzare leggere continuare verificato funziona raggiunta raggiungibile può",
        GLUE: "il lo la gli i le un una di del della dei in nel questo questa suo tuo per con e o che è sono stato stata più tardi momento si a al alla", OFF: "disabilitato disattivato richiesto abilitato", BODY: "testo contenuto", FILL: "segnaposto", COME: "arrivo seguire", GRANT: "permesso accesso autorizzazione",
    },
    "pt": {
        FAIL: "erro erros falhou falha rejeitado inacessível suspenso negado proibido expirada expirou indisponível manutenção problema inesperado quebrado inválido", THING: "página sítio documento arquivo ficheiro serviço servidor pedido solicitação conexão ligação endereço acesso permissão sessão navegador aplicação aplicativo",
        ACT: "habilite habilitar ative ativar active permita requer precisa necessita deve favor tente recarregue", NOT: "não sem nenhum", SEE: "existe encontrada encontrado válido válida acessar abrir existe suporta enviar carregar ver visualizar ler continuar ocorreu funciona disponível pode",
        GLUE: "o a os as um uma de do da dos das em no na este esta seu sua para por com e ou que é são foi mais tarde novamente momento se ao à esse essa", OFF: "desativado desabilitado desactivado necessário obrigatório", BODY: "texto conteúdo", FILL: "fictício exemplo", COME: "breve aqui", GRANT: "permissão acesso autorização",
    },
    "nl": {
        FAIL: "fout fouten geweigerd verboden verlopen onbeschikbaar onderhoud probleem onverwachte storing ongeldig mis", THING: "pagina document bestand dienst verzoek verbinding adres toegang sessie koppeling toepassing",
        ACT: "schakel inschakelen activeer activeren vereist nodig moet probeer herlaad toestaan sta", NOT: "niet geen zonder", SEE: "gevonden gaan geldig bereiken verzenden ondersteunt beschikbaar bereikbaar laden openen bekijken lezen bestaat opgetreden werkt verwerkt doorgaan gegaan",
        GLUE: "de het een is zijn wordt werd heeft hebben u uw we wij ons dit deze dat van in op aan voor met en of om te later opnieuw nog momenteel tijdelijk er iets kan kunnen kon worden door in", OFF: "uitgeschakeld ingeschakeld geblokkeerd", BODY: "tekst inhoud voorbeeldtekst opvultekst", FILL: "voorbeeldtekst opvultekst", COME: "volgt", GRANT: "toegang toestemming rechten",
    },
}

_LEXICON = Lexicon(_WORDS)
parts_of = _LEXICON.parts
_TOKEN = re.compile(r"(?<![^\W_])[^\W\d_]+(?![^\W_])")
_PLACES = re.compile(r"\S*[/\\]\S*|\b\S+\.(?:php|py|html?|js|aspx?|com|org|net)\b")
_STATUS = re.compile(r"\b[45]\d\d\b")
#: What a status stands for, as the protocol has it (fixed values).
_REASON = re.compile(
    r"\b(?:bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|not acceptable|request time-?out|conflict|gone|too many requests|internal (?:server )?error|not implemented|bad gateway"
    r"|service (?:temporarily )?unavailable|gateway time-?out|nicht gefunden|introuvable|no encontrad[oa])\b"
)
#: Words that a sentence about an act in the past needs.
_TOLD = re.compile(r"\b(?:had|hatten?|avai(?:t|ent)|había|habían|answered|obliged|yesterday|gestern|hier soir|ayer)\b")


def triggers() -> str:
    """A pattern, for texts in lower case, without which a text has no notice; it is of the kind that is matched in linear time."""
    stems = _LEXICON.of(SCRIPT, FAIL, FILL, GRANT)
    ends = {r"\b" + re.escape(w.rstrip("*")) + ("" if w.endswith("*") else r"\b") for w in stems}
    # What is missed rather than failed, and what is still to come, by the words that tell.
    ends |= {rf"\b{w}\b" for w in "geladen geöffnet angezeigt existe found available reached existe existiert existiert ocurrido ocurrió ocorreu loaded opened displayed matches gefunden erreichbar verarbeitet aufgetreten antwortet verfügbar vorhanden trouvée trouvé répond encontrado encontrada disponible responde trovata gevonden bereikbaar bereikt provisoire remplacer cargar".split()}
    ends |= {r"not be\b", r"too (?:long|many)\b", r"(?:not|n't) (?:find|load|open|reach|display)\b", r"(?:too|zu) lang\w*", r"payment required", r"gateway time", r" compl[eé]ter\b", r"(?:not|n't) (?:exist|work|respond|be|have)", r"\bconflict\b", r"not (?:implemented|acceptable)"}
    ends |= {rf"\b{w}\b" for w in "folgt ergänzt nachgereicht demnächst kürze bald prochainement bientôt venir próximamente breve pronto pendiente pending coming soon follow written tba goes replace".split()}
    return "|".join(sorted(ends))


#: Words for scripts that mean other things as well, so that they need company.
_LOOSE = {"langage", "lenguaje"}
_PLAYED = {"script", "scripts"}
#: An act in the past, of which a notice tells only where it speaks of machines, to its reader, or of this place.
_WAS = {"was", "were", "war", "waren", "wurde", "wurden", "fut", "fue", "fueron", "furent"}
_HERE = set("this that these diese dieser dieses cette ce ces esta este questa questo deze dit".split())
#: Words by which a notice speaks to its reader.
_READER = set("you your please we requested bitte sie ihr ihre veuillez vous votre usted su favor".split())


def _judge(words: list[str], low: str) -> str | None:
    has, alien, n = set(), 0, len(words)
    most = n // 2 if n <= 16 else max(1, n // 5)  # no rule allows more words outside the lexicon
    counts = [0] * 13
    for w in words:
        parts = parts_of(w)
        if not parts and len(w) > 1:
            alien += 1
            if alien > most:
                return None
        for p in parts:
            counts[p] += 1
            has.add(p)
    if _TOLD.search(low):
        alien += 2
    # Scripts, and what is to be done or was done with them; a word in five may be any.
    told = {w for w in words if SCRIPT in parts_of(w)} - _LOOSE
    if "noscript" in words or SCRIPT in has and has & {ACT, NOT, OFF} and n >= 3 and told and alien * 5 <= n and (alien == 0 or told - _PLAYED):
        return "script"
    status = bool(_STATUS.search(low))
    if alien <= 1 and (_REASON.search(low) and (status or n <= 4) or status and FAIL in has and n <= 8):
        return "error"
    # Words for filler, or for a text that is still to come.
    if alien == 0 and (FILL in has and has & {BODY, COME} or has >= {BODY, COME} and n <= 8 and not has & {FAIL, ACT, NOT}):
        return "filler"
    if counts[COME] >= 2 and n <= 16 and not has & {FAIL, NOT, OFF} and any(COME in parts_of(w) for w in words[:6]) and "pending" not in words:
        return "filler"
    # Something failed, or something looked for or allowed is not there; all words are of that kind.
    failed = counts[FAIL] > 0
    past = NOT not in has and _WAS.intersection(words) and NET not in has and not (_READER | _HERE).intersection(words)
    if alien == 0 and n >= 2 and not past and (failed or NOT in has and has & {SEE, GRANT} or has >= {ACT, GRANT} and _READER.intersection(words)):
        if has & {THING, NET} or counts[FAIL] >= 2 or failed and (n <= 3 and "under" in words or n <= 8 and has & {SEE, COME}):
            return "error"
    return None


def kind_of(sentence: str) -> str | None:
    """``script``, ``error`` or ``filler`` if the sentence is such a notice, or begins as one that speaks to its reader; else None."""
    low = sentence.lower().replace("can't", "can not").replace("won't", "will not").replace("n't ", " not ").replace("too long", "toolong").replace("zu lange", "zulange")
    words = _TOKEN.findall(_PLACES.sub(" ", low) if "/" in low or "\\" in low or "." in low[:-1] else low)
    if not words:
        return None
    if kind := _judge(words, low):
        return kind
    known = next((i for i, w in enumerate(words) if len(w) > 1 and not parts_of(w)), len(words))
    begun = words[:known]
    return _judge(begun, " ".join(begun)) if 6 <= known < len(words) and _READER.intersection(begun) else None
