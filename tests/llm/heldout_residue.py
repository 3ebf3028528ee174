"""Texts with and without residue that are not from the test tables. FIRST was written before the lexicon saw anything but the
tables, then used to mend it; SECOND, THIRD and FOURTH were written after that, one by one, and used alike; FIFTH was written last and has changed nothing."""

FIRST = (
    """\
Dear [Client Name], thank you for your letter.
502 Bad Gateway nginx/1.18.0
Please turn JavaScript on and reload the page.
Sorry, this page isn't available.
Hi %recipient.name%, your parcel is on its way.
Under construction
Pagina non trovata.
Abilita JavaScript per continuare.
Página não encontrada.
Ative o JavaScript para continuar.
De pagina kan niet worden gevonden.
Schakel JavaScript in om door te gaan.
404 Not Found
Error 500: Internal Server Error
This site requires JavaScript to function properly.
You need to enable JavaScript to run this app.
JavaScript is not available.
We've detected that JavaScript is disabled in this browser.
JavaScript seems to be disabled in your browser.
Veuillez activer JavaScript pour utiliser cette application.
Diese Seite benötigt JavaScript.
Bitte schalten Sie JavaScript ein.
Para continuar, habilite JavaScript en su navegador.
Necesitas JavaScript para ver esta página.
Your connection has timed out.
The connection was reset.
This site can't be reached.
The server is temporarily unable to service your request.
Service temporarily unavailable
Access denied.
You are not authorized to view this page.
Your session has timed out. Please log in again.
The requested URL was not found on this server.
Oops, something went wrong. Please try again later.
An error occurred while processing your request.
Seite nicht gefunden
Diese Seite ist derzeit nicht verfügbar.
Der Server ist nicht erreichbar.
Es ist ein unbekannter Fehler aufgetreten.
Zugriff verweigert
Cette page n'existe pas.
Le serveur ne répond pas.
Une erreur est survenue, veuillez réessayer.
Accès refusé
Esta página no existe.
El servidor no responde.
Ha ocurrido un error inesperado.
Acceso denegado
Si è verificato un errore.
Ocorreu um erro inesperado.
Er is een fout opgetreden.
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
This is placeholder text.
Sample text here.
Your text goes here.
Content coming soon.
Hier entsteht demnächst der Inhalt.
Hier könnte Ihr Text stehen. Platzhaltertext.
Texte à venir.
Texto de relleno.
Dear {{first_name}}, we write about your case.
Dear ${customerName}, we write about your case.
Sehr geehrte Frau [Nachname], wir danken Ihnen.
Estimado [Nombre del cliente], le escribimos.
Madame [NOM], nous vous écrivons.
The hearing is on [insert date] at the court.
The hearing is on <DATE> in room 4.
Amount due: ______________
Name: ____________________
Please pay <<AMOUNT>> by Friday.
Sent to %FIRST_NAME% on Monday.
The claimant, [Name of claimant], asks for costs.
TODO: add the summary
test test test test test test test test test
xxx xxxx xx xxx xxxxxx xxx xxxx
asdf asdf asdf asdf asdf asdf asdf asdf
java.io.IOException: Broken pipe
Traceback (most recent call last):
Fatal error: Uncaught Exception in /var/www/index.php on line 42
{"error": "not found"}
HTTP/2 503 Service Unavailable""".split("\n"),
    """\
The actor needs scripts early.
The server is down the road from the courthouse.
No se puede entregar el documento sin firma.
The document was found in the warehouse on Tuesday.
The judge denied access to the file on 3 May.
He moved to a page of his own book.
The clerk's browser history was produced as exhibit 4.
The error in the ledger was corrected by the auditor.
The link between the two companies was never proven.
The session of the court closed at noon.
Access to the harbour was blocked by ice for six days.
The service of the writ failed because the address was wrong.
The page is torn and the last lines are missing.
The witness could not find the file in the archive of the port.
Der Zeuge konnte die Akte im Archiv nicht finden.
Das Dokument wurde im Lager gefunden.
Der Fehler im Buch wurde vom Prüfer berichtigt.
Die Sitzung des Gerichts wurde um zwölf Uhr geschlossen.
Le témoin n'a pas trouvé le dossier dans les archives du port.
L'accès au quai était fermé pendant la tempête.
L'erreur du registre fut corrigée par l'expert.
El testigo no encontró el expediente en el archivo del puerto.
El acceso al muelle estaba cerrado por la tormenta.
The developer explained that JavaScript was enabled on every terminal of the depot.
The contract obliged the supplier to deliver scripts for the customs form.
The portal answered 503 for an hour, and the brief was filed on paper.
On Monday the docket system reported an internal error while the clerk was filing.
Error rates in the weighing logs fell to 404 per year.
The template uses the field {{name}} for the recipient.
The variable ${case_id} is replaced when the letter is printed.
The text "Page not found" was printed on the exhibit.
He wrote „Seite nicht gefunden“ on the cover.
The note reads [sic] as written.
The word was [illegible] in the copy.
Section [3] of the contract applies.
He paid <net> of all fees.
The sample of the grain was taken on 4 May.
The placeholder clause was struck from the contract in March.
The dummy corporation held the shares until 2019.
A new wing of the courthouse is under construction on Mill Street.
Construction of the quay began in 2014.
The maintenance of the crane was closed out in June.
The text follows the wording of the 1998 statute.
Content of moisture was 14 per cent.
The lorry broke down and the driver asked for help.
The request for costs was refused.
The request was denied with costs.
Ihre Anfrage vom 3. Mai haben wir an die Kammer weitergeleitet.
Der Dienst am Hafen ist seit Montag eingestellt.
Die Seite 14 der Akte fehlt.
La page 14 du dossier manque.
Falta la página 14 del expediente.
The parties did not reach an agreement.
The truck could not be loaded before the storm.
The container could not be opened without the second key.
She could not open the file because the seal was intact.
The address on the envelope was invalid, so the letter came back.
The password of the vault was changed by Mr Holt.
The firewall of the boiler room was rebuilt in brick.
We experienced technical difficulties with crane 4 on Tuesday.
The witness said the network of smugglers was broken.
He tried again later and found the gate closed.
Please contact the registry if the hearing date is wrong.
Please enable the bearer to pass.
Please turn on the light before entering the hold.
The guide requires that every script be signed by the translator.
The play's script was lost in the fire.
The browser of the archive may borrow three volumes.
Two requests were too many for the board.
The proxy voted for the absent shareholder.
The host refused the guests entry.
An exception applies to perishable goods.
The exception in clause 4 was invoked by the carrier.
Warning: the deck is slippery on line 2 of the jetty.
The file at issue is file 404 of the 1990 series.
Docket 503 was joined with docket 504.
The invoice number is 500.
A bad request from the agent led to the conflict.
The gateway to the yard stood open.
Unknown persons entered the site at night.
The site manager denied it.
Le lien de parenté n'est pas établi.
El enlace sindical no firmó el acta.
Il documento è stato firmato a Genova.
O documento foi assinado no Porto.
Het document is in Rotterdam getekend.""".split("\n"),
)
SECOND = (
    """\
Dear [First Name] [Last Name],
Hello {{ user.firstName }}, your order has shipped.
Kind regards, <YOUR NAME>
Best regards, [Your Signature]
The meeting takes place on [DATE] at [TIME].
Sehr geehrter Herr {Nachname},
Rechnungsnummer: __________
Cher [prénom], merci pour votre message.
Estimado/a {{nombre}}, gracias por su mensaje.
Lorem ipsum dolor sit amet
Placeholder. Replace this paragraph.
Beispieltext folgt in Kürze.
Contenu à compléter.
Contenido próximamente.
504 Gateway Time-out
HTTP ERROR 404
403 Forbidden
429 Too Many Requests
We're sorry, but something went wrong.
This page could not be found.
The page you are looking for does not exist.
The resource you requested is unavailable.
You don't have access to this document.
Your request has been blocked.
Connection refused
Database connection failed
This website is under maintenance.
Wir führen Wartungsarbeiten durch. Der Dienst ist nicht verfügbar.
Die Verbindung wurde unterbrochen. Die Seite kann nicht geladen werden.
Ihre Sitzung ist abgelaufen.
Page introuvable
Votre session a expiré.
La connexion a échoué. Le site est inaccessible.
Su sesión ha expirado.
El sitio está en mantenimiento.
Errore interno del server.
Sessão expirada. Entre novamente.
Toegang geweigerd
Enable JavaScript and cookies to continue
JavaScript is required to view this page.
Please allow scripts in your browser settings.
Your browser does not support JavaScript.
Ihr Browser unterstützt kein JavaScript.
JavaScript doit être activé pour afficher cette page.
Active JavaScript en su navegador para continuar.
Questa pagina richiede JavaScript.
Este site precisa de JavaScript.
Deze site vereist JavaScript.
System.NullReferenceException: Object reference not set
lorem lorem lorem lorem lorem lorem lorem""".split("\n"),
    """\
The access road was blocked by a fallen tree.
The permission of the harbour master was missing from the file.
The right of access is not disputed between the parties.
Kein Zeuge hat die Seite gelesen.
Der Zugang zum Lager war gesperrt.
Die Wartung des Krans kostete 4000 Kronen.
Das Gericht hat keinen Fehler gefunden.
Die Verbindung zwischen den Firmen ist unbekannt.
Le tribunal n'a trouvé aucune erreur dans le registre.
La demande de frais est refusée.
L'accès au dossier a été accordé le 3 mai.
El tribunal no encontró ningún error en el registro.
La solicitud de costas fue denegada.
El permiso del capitán no figura en el acta.
The court found no error in the record.
The record does not show who opened the hold.
The appeal was dismissed as the time limit had expired.
The licence expired in March and was not renewed.
The contract of service expired on 1 May.
A technical problem with the scale was reported by the crew.
The problem of the missing page was raised at the hearing.
The crew was unable to reach the port in time.
The insurer declined the claim because the seal was broken.
The broken seal was found next to the door.
The cargo was moved to another warehouse while the site was closed.
The internal report is missing from the annex.
Please see page 14 of the file.
Please contact us before the next hearing.
Please sign and return the enclosed copy.
We regret the delay in answering your letter.
Your request for a copy of the file has been granted.
Your request of 4 May reached us on Friday.
The file requested by the parties is kept in room 12.
The client named the recipient in the deed.
The amount is stated in brackets [see below].
The [first] clause was struck out.
The court [sitting in Genoa] heard the parties.
Prices are given in {thousands} of crowns.
He noted «sans réserve» on the slip.
The rate rose by 5% and fell by 3% a year later.
See note <3> on the plan.
The sample text of the standard contract was annexed to the claim.
An example of such a clause is found in the lease.
The description of the goods follows in annex B.
The text of the judgment follows the draft of the reporting judge.
The content of the crates was listed by two officers.
The actors read the script without a break.
The scripts of both witnesses were compared by the expert.
He writes his scripts in JavaScript for a shipping company in Bremen.
The company's website sells maps and needs no introduction.""".split("\n"),
)
THIRD = (
    """\
Dear [Customer Name], your file is closed.
Signed: [Your Name], [Your Title]
Votre référence : {{reference}}
Hello <<FirstName>>, welcome.
Address: ______________________
Datum: ________________
Guten Tag {{ anrede }} {{ nachname }}
Bonjour ${prenom},
Estimada [Apellido], adjuntamos la copia.
Lorem ipsum dolor sit amet, sed do eiusmod tempor.
Dummy text. Replace before publishing.
Content to be added soon.
Text folgt in Kürze.
Texte provisoire à remplacer.
Texto pendiente.
500 Internal Server Error
Error 403: Forbidden
HTTP/1.1 404 Not Found
Sorry, we could not load this page.
The file you requested does not exist.
You are not allowed to access this resource.
This service is currently offline.
The connection to the server failed.
An internal server error has occurred.
Die Datei konnte nicht geladen werden.
Der Zugriff auf diese Seite wurde verweigert.
Ein unerwarteter Fehler ist aufgetreten.
Le service est indisponible pour le moment.
Le fichier demandé est introuvable.
No se pudo cargar la página.
El archivo solicitado no existe.
Il servizio non è disponibile.
O serviço está indisponível.
De server is niet bereikbaar.
This application requires JavaScript.
Scripts are blocked in your browser.
Please enable JavaScript in your browser and refresh the page.
JavaScript ist deaktiviert. Bitte aktivieren Sie es.
JavaScript est nécessaire pour afficher cette page.
JavaScript está deshabilitado en su navegador.
It looks like JavaScript is turned off.
JavaScript è disabilitato nel browser.
org.hibernate.LazyInitializationException: no session
abc abc abc abc abc abc abc abc abc abc""".split("\n"),
    """\
The address of the firm is unknown to the court.
The harbour service was interrupted by the strike.
The request to admit the document failed.
An unknown person opened the file in the registry.
The document in question does not exist, said the broker.
No page of the log was read aloud.
The station was closed and the platform empty.
Der Zeuge hat die Anfrage nicht beantwortet.
Die Akte wurde verschoben, weil der Richter krank war.
Die gesuchte Person ist unbekannt.
Die Erlaubnis der Behörde liegt nicht vor.
Das Konto war gesperrt.
Le serveur du restaurant n'a rien vu.
La page du registre est déchirée.
Le document a été refusé par le greffe.
El servidor público no compareció.
La dirección del testigo es desconocida.
El documento fue rechazado por el juzgado.
The servant denied that the door was closed.
The error was found on page 4.
The failure of the crane was a technical one.
We cannot accept the offer of 4 May.
You cannot rely on an invoice that is missing.
Please read the rules before the hearing.
Please allow three weeks for delivery.
You must enable the inspector to enter.
The application for leave was out of time.
The application was refused.
Access to water was not a right of the tenant.
The link road is closed for repairs until June.
A page boy brought the note.
The site is contaminated, the expert found.
The script of the film was not delivered.
She turned the script over and read the back.
He needs a script for the medicine.
The data show no loss.
The text is complete.
The content was as described.
Replace the seal and sign the slip.
[Counsel confers with the witness.]
The deed names [redacted] as the heir.
He was paid {sic} twice.
Weights are in kg (dry) and lb (wet).
The bearer of «Aurora» signed.""".split("\n"),
)
FOURTH = (
    """\
Dear [Recipient Name], enclosed is the form.
Betrag: ____________ Euro
Name des Kunden: {{kunde}}
Hola {nombre}, su cita es el lunes.
Salut %PRENOM%, à bientôt.
Text text text text text text text text
Filler text only.
Dies ist nur ein Platzhaltertext.
Texte de remplissage.
Texto de prueba.
410 Gone
Error 502
HTTP 503: Service Unavailable
This link has expired.
The document you requested cannot be displayed.
We could not find the page you were looking for.
You need permission to view this file.
The server encountered an internal error.
Your browser sent an invalid request.
Diese Website ist nicht erreichbar.
Die Seite existiert nicht.
Bitte melden Sie sich erneut an, Ihre Sitzung ist ungültig.
Ce site est inaccessible.
Impossible de charger la page.
Vous n'êtes pas autorisé à consulter cette page.
Este servicio no está disponible.
El enlace ha caducado.
La richiesta non è valida.
Acesso negado.
JavaScript must be enabled.
This page needs JavaScript.
Aktivieren Sie JavaScript in den Einstellungen Ihres Browsers.
Votre navigateur n'accepte pas JavaScript.
Debe activar JavaScript para usar este sitio.""".split("\n"),
    """\
The page was signed by both parties.
The server brought the wine at eight.
The session was adjourned.
The portal of the church was restored.
The permission was revoked in May.
The file is complete.
The link between the payments is clear.
No error was made by the surveyor.
The failure to answer was noted.
The witness was unavailable on Monday.
Access is by the north gate.
The site of the fire was searched.
Die Seite wurde vom Zeugen unterschrieben.
Der Dienst begann um sechs Uhr.
Der Fehler lag beim Spediteur.
Die Sitzung wurde vertagt.
La session du tribunal est levée.
Le service de nuit a trouvé la porte ouverte.
El servicio de guardia encontró la puerta abierta.
La sesión fue aplazada.
The maintenance fee was paid in full.
The construction of the clause is disputed.
The script was written by hand.
Turn the page and read the second entry.
Please try the other door.
The request was granted.
The content of the letter was read out.
Example: the lease of 4 May.
The following text was added by hand.
The [last] page is blank.
He moved that the exhibit be refused.
The crane is out of order.
A new page follows.
The account is closed.""".split("\n"),
)
FIFTH = (
    """\
Dear [Applicant Name], we received your form.
Ref: [[reference_no]]
Hello ${user.name}!
Sehr geehrte Damen und Herren, [Betrag einfügen] ist fällig.
Fecha: ____________
lorem ipsum dolor
Sample content, please ignore.
Hier steht nur Fülltext.
aaa bbb aaa bbb aaa bbb aaa bbb aaa bbb
400 Bad Request
Error 429 - Too Many Requests
The document could not be loaded.
Your login session is no longer valid.
Page cannot be displayed.
We are unable to process your request at this time.
Unexpected error, please contact support.
Diese Datei ist beschädigt und kann nicht geöffnet werden.
Sie sind nicht berechtigt, diese Seite zu sehen.
Le lien que vous avez suivi est rompu.
La connexion a été interrompue.
No tiene autorización para acceder a este recurso.
La página que busca no existe.
Il sito è in manutenzione.
A página solicitada não existe.
Het verzoek kon niet worden verwerkt.
JavaScript needs to be enabled to see this content.
Your browser is blocking JavaScript.
Sie müssen JavaScript aktivieren.
Merci d'activer JavaScript.
Habilite JavaScript y recargue la página.""".split("\n"),
    """\
The shipment could not be released without a permit.
The master was not authorised to sign.
Our office is closed on Fridays.
The lock was broken and the door stood open.
The request was sent to the carrier.
The judge asked for the file.
The page numbers do not match the index.
The server of the writ was paid.
Der Antrag wurde abgelehnt.
Der Schaden ist nicht gedeckt.
Die Datei enthält 14 Blätter.
La preuve n'est pas recevable.
Le contrat a expiré le 4 mai.
El recurso fue rechazado.
La prueba no es válida.
Il ricorso è stato rigettato.
O recurso foi rejeitado.
Het beroep is verworpen.
The script for the hearing was agreed.
The texts differ in one word.
The sample weighed 4 kg.
A copy follows by post.
The system of weights is old.
The error margin was 4 per cent.
The address for service is Mill Street 4.
He could not find the key.
Access to justice is a right.
You may appeal within a month.
The [sic] marks are ours.
Rent is due on the first <of the month>.""".split("\n"),
)
