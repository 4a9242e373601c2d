"""Labelled exemplars of residue: (label, text). Public, everyday wording; a caller may pass a table of their own instead.

A text may run over several lines; a window is compared with the whole of it. @ stands for an
unfilled placeholder of any syntax, FAULT for the name of an error class, FILE for a file with
its line, PATH for a dotted call, # for a number.
"""

EXEMPLARS: list[tuple[str, str]] = [
    # Letters and reports of which only the frame is filled.
    ("template", "@"),
    ("template", "Dear @, thank you for @. We saw @ in clinic on @ with @. Sincerely, yours, regards, @. Signed by @ on behalf of @."),
    ("template", "Patient @ was admitted on @ for @ from @ to @ and was discharged home on @. The patient presented with @ and was treated with @. Tolerated @ well and was sent to @. He she they has a history of @."),
    ("template", "Name: @ First last name: @ Date of birth: @ Age: @ Sex: @ Gender: @ Address: @ Phone: @ Email: @ Hospital: @ Unit: @ Room: @ Service: @ Attending: @ Physician: @ Provider: @ MRN: @ ID: @"),
    ("template", "Admission date: @ Discharge date: @ Time: @ Allergies: @ Medications: @ Dose: @ Exam: @ Labs: @ Results: @ Impression: @ Diagnosis: @ Procedure: @ Plan: @ Course: @ Findings: @ History: @ Comments: @"),
    ("template", "Follow up with @ on @ in @ weeks at @. Call @ with questions. Return to @ if @."),
    ("template", "Sehr geehrte geehrter Frau Herr Kollegin Kollege @, wir berichten über @, geboren am @, wohnhaft in @. Patient Patientin @ wurde am @ wegen @ aufgenommen und mit @ behandelt. Entlassung am @ mit @. Diagnose: @ Therapie: @ Befund: @ Mit freundlichen Grüßen @"),
    ("template", "Estimado estimada doctor @, informamos sobre @ de @ años. El la paciente @ ingresó el @ por @ y fue tratado con @. Alta el @ con @. Diagnóstico: @ Tratamiento: @ Nombre: @ Fecha: @ Atentamente @"),
    ("template", "Cher chère confrère docteur Madame Monsieur @, nous avons vu @ en consultation le @. Le la patient patiente @ a été admis admise le @ pour @ et traité par @. Sortie le @ avec @. Diagnostic : @ Traitement : @ Nom : @ Date : @ Cordialement @"),
    # Filler.
    ("filler", "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua"),
    ("filler", "xxx"),
    ("filler", "keyboard asdf qwerty zxcv hjkl"),
    ("filler", "test test testing one two three. This is only a test. This is a test note, document, page, entry; please ignore, disregard, delete."),
    ("filler", "dummy text dummy content sample text sample content example text filler text mock data fake data blah blah foo bar baz"),
    ("filler", "Type your text here. Enter text here. Type note here. Click here to enter text. Replace this text with your own summary. Your content goes here. Insert text here. Add your description here. Write something here."),
    ("filler", "Placeholder. This is placeholder text, a placeholder paragraph, for layout, design, review, preview. Text to be added later. Content coming soon. To follow. Under construction. Intentionally left blank."),
    ("filler", "TBD to be determined to be announced to be completed to be done TBA TODO TBC FIXME N/A not applicable pending"),
    ("filler", "Platzhalter Blindtext Mustertext Beispieltext. Hier steht Ihr Text. Text folgt. Bitte Text eingeben. Dies ist ein Test."),
    ("filler", "texto de ejemplo texto de prueba texto de relleno. Escriba aquí su texto. Introduzca el texto aquí. Esto es una prueba. Contenido pendiente próximamente."),
    ("filler", "texte d'exemple texte de test faux texte. Saisissez votre texte ici. Insérer le texte ici. Ceci est un test. Contenu à venir."),
    # Pages of a server or proxy.
    ("error", "HTTP Status # Error # Code # Bad Request Unauthorized Forbidden Not Found Method Not Allowed Request Timeout Conflict Gone Too Many Requests Internal Server Error Not Implemented Bad Gateway Service Unavailable Gateway Timeout"),
    ("error", "404 page not found. The page, document, file or record you asked for, requested or are looking for could not be found, does not exist, was moved, removed or deleted, or has expired. The requested URL, address or resource was not found on this server. Check the address and try again. Go back to the home page, front page, start page."),
    ("error", "403 access denied. Forbidden. You do not have permission, rights or authorization to access, open or view this page, report, document, record, resource on this server. Contact your administrator."),
    ("error", "500 internal server error. The server encountered an internal error or misconfiguration and was unable to complete your request. Sorry, an unexpected error occurred, something went wrong while loading, opening or displaying this page, note, document. Oops! We are sorry for the inconvenience. Please try again later."),
    ("error", "502 bad gateway 503 service unavailable 504 gateway timeout nginx apache tomcat varnish cloudflare iis. The server, service, site or system is temporarily unavailable, overloaded, down or offline for maintenance, not available at this time. Please wait and try again in a few minutes. The proxy server received an invalid response from an upstream server."),
    ("error", "Your session has expired, timed out, ended. Please sign in, log in again to continue, to see this record. You have been logged out. Invalid user name or password. Authentication required."),
    ("error", "Checking your browser before accessing. This process is automatic. Verify you are human. Please complete the captcha. DDoS protection. Ray ID. Your IP address has been blocked. Just a moment. Attention required."),
    ("error", "Error code, error message, reference, ref, incident, request id, trace id, correlation id, status, message, details, timestamp, path: # Report this problem. Return to the list, work list, chart. Retry. Reload. Home. Back. Contact the help desk, support."),
    ("error", "html head title body h1 h2 p hr br div span center address doctype lang en charset meta error #"),
    ("error", "Unhandled exception FAULT. Uncaught error. Fatal error. Object reference not set to an instance of an object. Value cannot be null, value was null, undefined, none. Index out of range, out of bounds. Read timed out, connection timed out, timeout, refused, reset by peer, closed. Cursor is closed. Template not found, is missing. Out of memory. Access violation. Segmentation fault, core dumped. caused by FAULT"),
    ("error", "Exception in thread main java FAULT at PATH FILE at PATH line # caused by FAULT ... # more common frames omitted"),
    ("error", "at PATH line # in FILE line # at PATH FILE"),
    ("error", "Traceback most recent call last File FILE line # in module raise return self FAULT KeyError ValueError TypeError AttributeError object has no attribute"),
    ("error", "SQLSTATE SQL error ORA MySQL PostgreSQL database query failed syntax error near column unknown table doesn't exist relation does not exist duplicate entry deadlock could not connect to database server connection refused"),
    ("error", "Warning: Notice: Parse error: Fatal error: PHP undefined variable, index, function in FILE on line # headers already sent stack trace thrown"),
    ("error", "Null undefined NaN object Object status error message trace code data success false"),
    ("error", "Seite nicht gefunden. Die angeforderte Seite, das Dokument wurde nicht gefunden, existiert nicht mehr. Zugriff verweigert. Sie haben keine Berechtigung. Interner Serverfehler. Ein Fehler ist aufgetreten. Der Dienst, Server ist zurzeit, derzeit, vorübergehend nicht verfügbar, erreichbar. Bitte versuchen Sie es später erneut, in einigen Minuten noch einmal. Ihre Sitzung ist abgelaufen. Bitte melden Sie sich neu, erneut an. Fehlercode #"),
    ("error", "Página no encontrada. No se ha encontrado, no se encuentra, no existe la página, documento solicitada. Acceso denegado. No tiene permiso. Error interno del servidor. Se ha producido, ha ocurrido un error. El servicio, servidor no está disponible en este momento, temporalmente. Inténtelo de nuevo más tarde, dentro de unos minutos. Su sesión ha caducado, expirado. Vuelva a iniciar sesión. Código de error #"),
    ("error", "Page introuvable. La page, le document demandée est introuvable, n'existe pas, plus. Accès refusé. Vous n'avez pas l'autorisation. Erreur interne du serveur. Une erreur s'est produite, est survenue. Le service, serveur est momentanément, temporairement indisponible. Veuillez réessayer plus tard, dans quelques minutes. Votre session a expiré. Veuillez vous reconnecter, vous identifier. Code d'erreur #"),
    # Notices that scripts are required, with what stands around them.
    ("scripts", "Please, you need to, must, have to enable, activate, allow, turn on, switch on JavaScript, scripts, scripting, cookies in your browser, settings to view, show, display, see, read, use, run, continue, access this page, site, website, report, application, app, viewer, document, note. It requires, needs JavaScript to work properly, correctly, and reload, refresh the page."),
    ("scripts", "JavaScript, scripting is disabled, turned off, blocked, not available, not supported in your browser; the page, content, report, note cannot be shown, displayed. You need to enable, switch it on. Your browser does not support this viewer, site, chart viewer. Upgrade to a modern browser."),
    ("scripts", "Loading, please wait. Skip to main content. Menu. Navigation. Search. Home. Chart. Results. Notes. Records. Viewer. Version #. noscript. Cookies help us run, improve this site, office. We use cookies. Accept all. Decline. Privacy policy. Terms of use. All rights reserved. Copyright (c) #"),
    ("scripts", "Bitte aktivieren, erlauben, schalten Sie JavaScript, Skripte, Cookies in Ihrem Browser ein, um diesen Bericht, diese Seite, Anwendung anzuzeigen, anzusehen, zu nutzen. Diese Seite, Anwendung benötigt, erfordert JavaScript, Skripte und Cookies. JavaScript ist in Ihrem Browser deaktiviert, ausgeschaltet. Laden Sie die Seite neu."),
    ("scripts", "Active, habilite, permita JavaScript, los scripts, las cookies de su navegador para ver, usar, continuar este informe, esta página, aplicación. Este visor, sitio, esta aplicación necesita, requiere JavaScript, scripts y cookies. JavaScript está desactivado, deshabilitado en su navegador. Vuelva a cargar la página."),
    ("scripts", "Veuillez activer, autoriser JavaScript, les scripts, les cookies dans votre navigateur pour afficher, utiliser, voir ce compte rendu, cette page, application. Cette application, page nécessite, requiert JavaScript, les scripts et les cookies. JavaScript est désactivé dans votre navigateur. Rechargez la page."),
]

#: The passage that pseudo-Latin filler is made from, with the words that its usual continuations add.
LATIN_PASSAGE = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
praesent vestibulum bibendum felis libero at ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae
nam a erat donec vel mauris nec tellus interdum cum sociis natoque penatibus et magnis dis parturient montes nascetur ridiculus mus
vivamus venenatis pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas
"""

#: Function words, which retrieve no exemplar.
STOP = """
a an and are as at be been but by can could did do does for from had has have he her his i if in into is it its may me my no not of on or our out
she so some that the their them then there they this to up was we were what when which who will with would you your
am an auf aus bei bis das dass dem den der des die ein eine einem einen einer es für hat ich ihr im ist mit nach nicht noch oder sich sie sind so um und
von vor war wie wir wird wurde zu zum zur
al como con de del el en es esta este fue ha la las le lo los más muy no o para pero por que se si sin sobre su sus un una y ya
au aux avec ce ces cette dans de des du elle en est et été il ils je la le les leur mais ne nous ou par pas pour qui sa se ses son sur un une vous
""".split()
