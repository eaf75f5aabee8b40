"""Word lists and sentence templates from which the redaction models are trained; written for this project."""

from __future__ import annotations

import random
import re
import unicodedata

from tallyframe.llm.langid_seed import SEEDS

# Words for single digits in several languages.
DIGIT_WORDS = frozenset(
    """cero uno una dos tres cuatro cinco seis siete ocho nueve zero um uma dois duas três quatro sete oito nove meia
    one two three four five six seven eight nine oh deux trois quatre cinq sept huit neuf un due quattro cinque sei sette otto
    null eins zwei drei vier fünf sechs sieben acht neun dues quatre cinc sis set vuit nou""".split()
)
# Words that name a kind of street.
STREETS = frozenset(
    """calle cll cl carrera cra cr kra kr avenida av avda avd diagonal diag dg transversal trans tv tr autopista vereda pasaje paseo plaza
    rua travessa alameda estrada praça via viale corso piazza vicolo carrer plaça passeig travessera ronda улица ул проспект""".split()
)
FRENCH_STREETS = ("rue", "avenue", "boulevard", "bd", "chemin", "impasse", "place", "allée", "quai")
ENGLISH_STREETS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "court", "ct", "boulevard", "blvd", "way", "terrace", "square", "close")
STREET_WORDS = frozenset({*STREETS, *FRENCH_STREETS, "street", "road", "lane", "straße", "strasse"})
MAIL_KEYS = frozenset("correo mail email e-mail escribir escribi carta usuario copia cuenta address write wrote reach llega contacto contactos adresse indirizzo endereço".split())
ID_KEYS = frozenset(
    """documento cedula cc dni ti pasaporte nit identificacion identidad cpf rg passport social security ssn license licencia ausweis reisepass personalausweis
    passeport carte identite carta codice fiscale nif nie tarjeta c carnet matricula expediente firme паспорт""".split()
)
PHONE_KEYS = frozenset(
    """tel telefono celular cel movil llamar llamando llame llamenme llamen marque marco whatsapp numero contacto contactos voz phone number call cell mobile telefon telephone telefone
    nummer appelle appeler ligue ligar handy telefonnummer fono fijo linea""".split()
)
UNITS = frozenset("pesos peso euros euro dolares usd cop mg kg km años anos horas hours veces paginas pages capitulos entregas minutos dias materias semanas grams metros por".split())
PLACE_KEYS = frozenset("vivo vive en a live at mude mudamos queda direccion papeles saliendo de moro mora na wohne in der habite habito abito deja arriendo por".split())
TITLES = frozenset("sr sra srta señor senor señora senora don doña dona dr dra doctor doctora ing lic prof profe profesor profesora mr mrs ms miss herr frau monsieur madame mme m dott signor signora tia tio sor fray seu".split())
CALENDAR = frozenset(
    """enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miercoles jueves viernes sabado domingo
    january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday""".split()
)


def _fold(word: str) -> str:
    flat = unicodedata.normalize("NFKD", word.lower())
    return "".join(c for c in flat if not unicodedata.combining(c))


COMMON = frozenset(_fold(w) for lang in ("es", "en", "pt", "ca", "fr", "it", "de") for w in re.findall(r"[^\W\d_]+", SEEDS[lang]))

# Given names that are ordinary words as well.
ORDINARY = ("Luz", "Consuelo", "Paz", "Mar", "Linda", "Blanca", "Reina", "Grace", "Hope", "Claro", "Flor", "Perla")
_SEED_LINES = {lang: re.findall(r"[^.]+\.", text) for lang, text in SEEDS.items()}
_ONSET, _CORE, _TAIL = "Bar Cal Den Fal Gor Hel Jam Kor Lam Mon Nar Pel Quin Ros Sal Tor Ur Val Yar Zam Br Tr Cl".split(), "a e i o u ei ia".split(), "ndo rez sco lla mar net rigo tano vera zuela gues ston field mann court berg nini dini rado ques".split()
_GIVEN_TAIL = "lis ris nia rdo cio lda nis mar dys bel rin ton nne ika lio via mir".split()

NAME_LINES = """Me llamo {N} y tengo veinte años.|Soy {N} y estudio enfermería.|Soy {N}, documento {I}, y vivo en {A} desde enero.|Ayer hablé con {N} y con {N} sobre el trabajo.|Entre {N}, {N} y yo pagamos la cuenta.|{N} me dijo que descansara.|{N} siempre me dice que coma.|{N} me pasó su número, {P}, por si acaso.
{N} me dio su número, {P}, por si algo.|Terminé con {N} hace un año.|Extraño a {N}, aunque no hablamos.|¿Usted conoce a {N}, la de la oficina?|Lo que dijo {N} en la clase me dolió.|Ese día {N} me acompañó a la clínica.|Mi mejor amiga, {N}, se mudó.|Mi amigo {N} no vino.|El profe {N} no me dejó salir.|La Dra. {N} me dijo que esperara.|El señor {N} llamó otra vez.
Le conté a {N} lo que pasó.|Fui con {N} al cine.|My name is {N} and I am a student.|My friend {N} drove me to school.|Ask {N} at {P} about it.|I wrote to {E} and to Mrs. {N} about it.|I met {N} on Monday.|Eu me chamo {N} e estudo aqui.|A minha amiga {N} me levou para casa.|Falei com {N} pelo {P} ontem.|Je m'appelle {N} et je suis ici.|Mon amie {N} m'a aidée.|J'ai vu {N} hier.
Ich heiße {N} und wohne hier.|Meine Freundin {N} hat mich besucht.|Mein Freund {N} war da.|Mi chiamo {N} e sono qui.|La mia amica {N} mi ha aiutato.|Em dic {N} i visc aquí.|{N} y yo fuimos a comer.|Según {N}, todo va bien.|{N} no me contesta.|Mi primo {N} y mi tía {N} viven lejos.|Con {N} discutí otra vez.|Entre {N}, {N} y mi tía compramos todo.|Con {N}, {N} y mi mamá salimos.|Ayer {N}, {N} y yo cenamos.|Mi mejor amigo, {N}, viajó lejos.|Mi prima, {N}, estudia mucho.|Mi compañera, {N}, dejó el trabajo.|Una vecina, {N}, me ayudó.|Mi mejor amiga, {N}, no volvió.|My sister, {N}, left school.|Gracias a {N} pude dormir."""
OTHER_LINES = """Mi correo es {E}, por si acaso.|Me pueden escribir a {E} cuando gusten.|Con copia a {E} y a {E}, como pidieron.|Le mandé la carta a {E}, pero no contestó.|El usuario que uso es {E} para la clase.|Todo llega a {E} y no lo leo.|You can reach me at {E} any day.|Meu e-mail é {E}, pode escrever.|Mon adresse est {E}, écrivez-moi.|Meine Adresse ist {E}, schreiben Sie mir.|我的邮箱是{E}，谢谢。|メールは{E}です。
Mi número es {P}, llámenme mañana.|El celular de mi mamá es {P}.|Estuve llamando al {P} toda la tarde.|Si no contesto, marque {P} y espere.|Anoté el tel. {P} de la línea de ayuda.|Quedó un mensaje de voz del {P} que no oí.|Contactos: {P}, {E} o con mi tía al {P}.|My number is {P}, call me.|Meine Nummer ist {P}, danke.|O meu telefone é {P}, liguem.|Mon numéro est le {P}, merci.|我的电话是{P}，谢谢。|電話番号は{P}です。
Mi cédula es {I}, ya la di.|El DNI {I} estaba vencido.|Me pidieron la C.C. {I} en la entrada.|Firmé con {I} en la hoja.|Firmé con {I} en el acta de la reunión.|Quedé registrado con el documento {I} y se equivocaron.|Soy la del pasaporte {I} que perdió el turno.|My social security number is {I}, if needed.|My passport {I} expired.|O meu CPF é {I}, já informei.|Mein Ausweis hat die Nummer {I} seit Mai.|Mon passeport porte le numéro {I} depuis mai.
Vivo en {A}, al lado de la tienda.|Me mudé a {A} con mi hermano.|Mándenme los papeles a {A}, por favor.|El bus me deja en {A} y de ahí camino.|Nos robaron saliendo de {A} el mes pasado.|La casa de mi abuela queda en {A} y allá duermo.|Pagamos el arriendo de {A} a medias.|Moro na {A}, perto da escola.|I live at {A}, next to a shop.|Ich wohne in der {A}, neben der Schule.|J'habite {A}, près du parc."""
PLAIN_LINES = """Aber jeden Dienstag bin ich müde.|Jeden Freitag gehe ich schwimmen.|Ich soll mehr trinken, aber jeden Sonntag vergesse ich es.|Jeden Mittwoch koche ich.|Seit Donnerstag habe ich Kopfweh.
Denken Sie, dass das hilft?|Haben Sie morgen Zeit für mich?|Meinen Sie, dass es besser wird?|Können Sie mir helfen?|Wissen Sie, was ich meine?|Sind Sie sicher, dass ich gehen soll?|Glauben Sie mir das?|Verstehen Sie, warum ich müde bin?|Ein Freund hat mich nach Hause gebracht.|Wollen Sie, dass ich warte?|Kennen Sie das Gefühl?
Mi amiga dejó la carrera. Bajé 4 kilos en un mes.|Terminó la carrera. Sacó 5 en la tesis.|Cerraron la plaza. Esperé 20 minutos y me fui.|Llegué a la avenida. Eran 8 buses seguidos.
Sígueme en @luna_23, que ahí publico.|Nos vemos @ las 5 en la entrada.|Compré una arroba de papa en la plaza.|Me etiquetaron como @grupo en la foto.|Follow me @sunny for more.|La nota salió @prensa.|Cargamos dos arroba de yuca en el bus.|El ensayo es a las 3 @ la sala de música.
La calle principal estaba llena.|Vivo por la calle principal, cerca del río, desde hace 3 años.|La avenida estaba vacía y llovía.|La Carrera de Derecho exige 4 prácticas y lecturas.|Mi hermana dejó la carrera.|La carrera de medicina dura 6 años.|Rosa era el color de la pared y del techo.|Sol y brisa en la playa, y aun así lloré.|Abril fue un mes largo, y luego llegó mayo.|Vi la luz del sol por la ventana.|La rosa que sembré se secó.|En abril tuve calma.|La luz entraba por la sala.|El sol salió tarde.
El grupo se llama Esperanza y somos cinco.|El Depto. de Salud y la Fac. de Artes llamaron.|Mi tío vive en EE. UU. desde hace seis años.|Fueron 300 páginas, 15 capítulos y 40 entregas.|Gasté $380.000 en comida.|Guardé 1.020.000 pesos para el viaje.|Pagué 89.990 pesos por repetirla.|Entre 2019 y 2023 perdí dos materias.|El puntaje fue 14/27 y luego 11/21, el lunes 12/05/2024.|Empezó el 12.03.2024 en la sede.|El formulario 300-14 y el turno 0555 no aparecían.|El salón 2-14 queda lejos.
El código era F32.1 según el informe, versión 2.0.1, y ya.|Tuve cita a las 10:30 en el consultorio 305 del piso 3.|Estuve en [LUGAR] con mi tía.|[NOMBRE] me llamó desde [LUGAR] ayer.|El Dr. [NOMBRE] me vio.|La Sra. [NOMBRE] no entiende.|Nadie en la casa sabe lo que pasa.|Trato de no pensar en eso mientras cocino.|Entonces me quedo mirando el techo.|Digamos que todo va mejor.|Bueno, eso es lo que siento.|Hay días en los que no quiero salir.|Lo que más me pesa es la beca.|La Ing. [NOMBRE] me ayudó.
Before going to sleep I read.|Honestly, the exam on Tuesday scares me.|Meine Mutter sagt, ich soll schlafen, und der Arzt auch.|Am Montag habe ich eine Klausur und dann gehe ich an den Fluss.|Am 12. Mai war ich im Krankenhaus.|Vor jedem Vortrag bekomme ich Angst.|Seit der Prüfung schlafe ich kaum und trinke Kaffee.|Mein Bruder hat mir ein Buch gegeben.|Der Arzt meint, ich brauche Ruhe.|In letzter Zeit habe ich keinen Hunger und gehe ins Bett.|Je suis fatiguée depuis lundi.|O que mais me preocupa é o futuro.|Mi mamá y yo hablamos dos veces de la casa.|Tardé cinco días en contarle a mi papá.|El turno es de 7:30 a. m. a 10:15 p. m. siempre.|Uno dos tres, empezamos a correr.|Antes bailar me gustaba y ahora no.|Las clases, el ruido, etc. me cansan.|Además, no duermo bien.|Entonces, me voy a casa.|Pues, nada nuevo.|La verdad, estoy cansada.|Digamos que ya pasó.|Honestly, I sleep badly.|Después de comer camino.|Hace tres meses no salgo.|Mora na Av. principal com a mãe.|My flat is on the Main Road in May and June.|In May at 9 a.m. I was ill.|He lives in the U.S. in May and likes it.|I met the teacher on Tuesday.|La Universidad Nacional cierra el lunes.|Fui a Bogotá con mi tía.|Estudio Psicología en la tarde.|La luz de la calle no funciona.|Busco consuelo y paz en el mar.|La casa blanca es linda.|La reina del coro cantó.|Una flor y una perla, nada más.|Claro que sí, eso creo.|Pensé: «Ojalá llueva pronto.»|Le dije: «Calma, ya pasa.»|Sol y arena por todas partes.|Sol, playa y nada más.|Esto no me gusta.|Eso me pasa siempre.|Paz es lo que busco.|Luz no había en la casa.|I hope it gets better.|Hope is what I need.|Wir haben noch zwei Wochen bis Oktober.|Meine Eltern und mein Bruder wohnen im Norden.|Das Wohnheim hat kein Licht.|During the week I work.|Die neue Stadt macht mir Angst und mein Kopf tut weh.|Mein kleiner Bruder und meine Schwester gehen zur Schule.|In zwei Wochen beginnt die Arbeit an der Uni.|Am Abend sitze ich am Fenster und höre ein Lied.|Das Geld und die Schulden machen mir Sorgen.|Jeden Morgen trinke ich Kaffee und lese die Zeitung.|Mein Vater hat die Wohnung in der Stadt verkauft.|Nach der Prüfung schlafe ich den ganzen Tag.|Seit einem Jahr habe ich Schmerzen im Rücken und in den Händen.|Der Freund meiner Cousine hat ein Zimmer im Norden.|Nach drei Monaten war die Trennung vorbei.|Die Meinung der Leute ist mir egal.|Für die Zukunft habe ich keinen Plan."""


def invented(rng: random.Random, tails: list[str]) -> str:
    return rng.choice(_ONSET) + rng.choice(_CORE) + rng.choice(tails)


def given_name(rng: random.Random, given: list[str]) -> str:
    if rng.random() < 0.1:
        return rng.choice(ORDINARY)
    return rng.choice(given) if given and rng.random() < 0.5 else invented(rng, _GIVEN_TAIL)


def person(rng: random.Random, given: list[str]) -> str:
    return " ".join([given_name(rng, given), *[invented(rng, _TAIL) for _ in range(rng.choice([0, 0, 1, 1, 1, 2]))]])


def digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def phone(rng: random.Random) -> str:
    d = lambda n: digits(rng, n)
    words = "cero uno dos tres cuatro cinco seis siete ocho nueve".split()
    return rng.choice([
        lambda: f"+57 3{d(2)} {d(3)} {d(4)}", lambda: f"+57 ({d(3)}) {d(7)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"3{d(2)}.{d(3)}.{d(2)}.{d(2)}", lambda: f"3{d(9)}", lambda: f"3{d(2)} {d(3)} {d(2)} {d(2)}", lambda: f"3{d(2)}-{d(3)}-{d(2)}-{d(2)}",
        lambda: f"+1 {d(3)} {d(3)} {d(4)}", lambda: f"+49 1{d(2)} {d(7)}", lambda: f"({d(2)}) {d(4)}-{d(4)}", lambda: f"+55 {d(2)} 9{d(4)}-{d(4)}", lambda: "+33 6 " + " ".join(d(2) for _ in range(4)), lambda: f"0{d(1)} " + " ".join(d(2) for _ in range(4)), lambda: "tres " + " ".join(rng.choice(words) for _ in range(9)), lambda: f"3{d(2)} {d(7)}",
    ])()


def identity(rng: random.Random) -> str:
    d = lambda n: digits(rng, n)
    lead = rng.choice("124567899999")
    letters = rng.choice(["XA", "AB", "P", "XX", "CC", "YB"])
    return rng.choice([
        lambda: f"{letters}{d(6)}", lambda: f"{letters}{d(7)}", lambda: f"{lead}{d(9)}", lambda: f"{lead}{d(7)}", lambda: f"{lead}.{d(3)}.{d(3)}.{d(3)}", lambda: f"{lead} {d(3)} {d(3)} {d(3)}", lambda: f"{lead}{d(7)}-{rng.choice('ABCDEFGHRT')}", lambda: f"{lead}{d(7)}{rng.choice('ABCDEFGHRT')}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", lambda: f"{lead}{d(1)}.{d(3)}.{d(3)}",
    ])()


def email(rng: random.Random, given: list[str]) -> str:
    a, b = _fold(given_name(rng, given)), invented(rng, _TAIL).lower()
    local = rng.choice([f"{a}.{b}", f"{a[0]}{b}{digits(rng, 2)}", f"{b}{digits(rng, 3)}", f"{a}_{b}", f"{a}-{b}+curso"])
    host, top = rng.choice(["correo", "mail", "uni", "campus", "buzon"]), rng.choice(["example", "test", "com", "org", "net"])
    if rng.random() < 0.2:
        return f"{a} punto {b} arroba {host} punto {top}"
    if rng.random() < 0.2:
        return f"{local} [at] {host} [dot] {top}"
    made = local + rng.choice(["@", "@", "@", " @ "]) + f"{host}.{top}"
    return made.upper() if rng.random() < 0.1 else made


def address(rng: random.Random, line: str) -> str:
    n, m, k = rng.randint(1, 140), rng.randint(1, 99), rng.randint(1, 99)
    word = invented(rng, _TAIL)
    if "I live" in line:
        return f"{n} {word} {rng.choice(['St.', 'Rd.', 'Ave', 'Street', 'Lane', 'Road'])}"
    if "wohne" in line:
        return f"{word}{rng.choice(['straße', 'strasse', 'weg', 'gasse'])} {n}"
    if "Moro" in line:
        return f"Rua {word}, {n}"
    if "habite" in line:
        return f"{n} rue {word}"
    made = rng.choice([f"Calle {n} # {m}-{k}", f"Cra. {n} No. {m}-{k}", f"Cl {n} n.º {m}-{k}", f"Carrera {n} con calle {m}", f"Avenida {word} {n}", f"Diagonal {n}A # {m} - {k}", f"Transversal {n} #{m}-{k}", f"calle {word} número {n}", f"Av. {word} {n}", f"Kr {n} # {m}-{k}"])
    return made + rng.choice(["", "", "", f", apto. {k}", f", piso {rng.randint(1, 9)}", f" torre {rng.randint(1, 9)}"])


def compose(rng: random.Random, given: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """A document and its mentions (kind, start, end)."""
    pools = [[s for part in lines.split("\n") for s in part.split("|") if s] for lines in (NAME_LINES, OTHER_LINES, PLAIN_LINES)]
    if rng.random() < 0.4:
        pools[2] = _SEED_LINES[rng.choice(("de", "de", "de", "es", "en", "pt", "fr", "it", "ca"))]
    text, gold = "", []
    for _ in range(rng.randint(1, 6)):
        line = rng.choice(pools[rng.choices([0, 1, 2], [4, 3, 5])[0]])
        text += rng.choice([" ", " ", " ", "\n", "  "]) if text else ""
        for part in re.split(r"(\{[NPIEA]\})", line):
            start = len(text)
            if part == "{N}":
                text += person(rng, given)
                gold.append(("name", start, len(text)))
            elif part == "{P}":
                text += phone(rng)
                gold.append(("phone", start, len(text)))
            elif part == "{I}":
                text += identity(rng)
                gold.append(("id_number", start, len(text)))
            elif part == "{E}":
                text += email(rng, given)
                gold.append(("email", start, len(text)))
            elif part == "{A}":
                text += address(rng, line)
                gold.append(("address", start, len(text)))
            else:
                text += part
    style = rng.random()
    changed = text.lower() if style < 0.22 else text.upper() if style < 0.36 else text
    return (changed if len(changed) == len(text) else text), gold
