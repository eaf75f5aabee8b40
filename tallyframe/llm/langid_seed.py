"""Seed texts for the language model, written for this project: everyday sentences, one language a key."""

SEEDS = {
    "es": "Ayer fui a la tienda con mi hermana porque necesitábamos pan y leche. No sé qué hacer cuando llega la noche y no puedo dormir. Mi mamá dice que todo va a salir bien, pero yo estoy muy cansada. Los domingos salgo a caminar por el parque y luego cocino algo sencillo. Desde que empezó el semestre me cuesta concentrarme en las clases. El profesor me pidió que entregara el trabajo antes del viernes. A veces pienso que nadie entiende lo que me pasa, aunque mis amigos intentan ayudarme. Me gusta escuchar música mientras arreglo la casa y lavo la ropa. Hace tres meses que vivo sola en un apartamento pequeño cerca del río. Si mañana llueve, me quedo en la cama leyendo un libro. Todavía no le he contado a mi papá lo de la beca.",
    "en": "Yesterday I went to the shop with my sister because we needed bread and milk. I do not know what to do when the night comes and I cannot sleep. My mother says that everything will be fine, but I am very tired. On Sundays I walk through the park and then I cook something simple. Since the term started it has been hard to concentrate in class. The teacher asked me to hand in the essay before Friday. Sometimes I think that nobody understands what is happening to me, although my friends try to help. I like to listen to music while I clean the house and wash the clothes. I have been living alone in a small flat near the river for three months. If it rains tomorrow, I will stay in bed and read a book. I still have not told my father about the money.",
    "pt": "Ontem fui à loja com a minha irmã porque precisávamos de pão e leite. Não sei o que fazer quando chega a noite e não consigo dormir. Minha mãe diz que tudo vai dar certo, mas eu estou muito cansada. Aos domingos saio para caminhar no parque e depois cozinho alguma coisa simples. Desde que o semestre começou, tenho dificuldade para me concentrar nas aulas. O professor pediu que eu entregasse o trabalho antes de sexta-feira. Às vezes acho que ninguém entende o que acontece comigo, embora os meus amigos tentem ajudar. Gosto de ouvir música enquanto arrumo a casa e lavo a roupa. Há três meses moro sozinha em um apartamento pequeno perto do rio. Se chover amanhã, fico na cama lendo um livro. Ainda não contei ao meu pai sobre a bolsa.",
    "ca": "Ahir vaig anar a la botiga amb la meva germana perquè necessitàvem pa i llet. No sé què fer quan arriba la nit i no puc dormir. La meva mare diu que tot anirà bé, però jo estic molt cansada. Els diumenges surto a caminar pel parc i després cuino alguna cosa senzilla. Des que va començar el semestre em costa concentrar-me a les classes. El professor em va demanar que lliurés el treball abans de divendres. De vegades penso que ningú no entén què em passa, tot i que els meus amics intenten ajudar-me. M'agrada escoltar música mentre endreço la casa i rento la roba. Fa tres mesos que visc sola en un pis petit a prop del riu. Si demà plou, em quedaré al llit llegint un llibre. Encara no he explicat al meu pare això de la beca.",
    "fr": "Hier je suis allée au magasin avec ma sœur parce que nous avions besoin de pain et de lait. Je ne sais pas quoi faire quand la nuit arrive et que je n'arrive pas à dormir. Ma mère dit que tout ira bien, mais je suis très fatiguée. Le dimanche je me promène dans le parc et ensuite je cuisine quelque chose de simple. Depuis le début du semestre j'ai du mal à me concentrer en cours. Le professeur m'a demandé de rendre le travail avant vendredi. Parfois je pense que personne ne comprend ce qui m'arrive, même si mes amis essaient de m'aider. J'aime écouter de la musique pendant que je range la maison et que je lave le linge. Depuis trois mois je vis seule dans un petit appartement près de la rivière. S'il pleut demain, je resterai au lit avec un livre. Je n'ai pas encore parlé de la bourse à mon père.",
    "it": "Ieri sono andata al negozio con mia sorella perché avevamo bisogno di pane e latte. Non so cosa fare quando arriva la notte e non riesco a dormire. Mia madre dice che andrà tutto bene, ma io sono molto stanca. La domenica cammino nel parco e poi cucino qualcosa di semplice. Da quando è cominciato il semestre faccio fatica a concentrarmi a lezione. Il professore mi ha chiesto di consegnare il lavoro prima di venerdì. A volte penso che nessuno capisca quello che mi succede, anche se i miei amici cercano di aiutarmi. Mi piace ascoltare la musica mentre metto in ordine la casa e lavo i vestiti. Da tre mesi vivo da sola in un piccolo appartamento vicino al fiume. Se domani piove, resto a letto a leggere un libro. Non ho ancora parlato della borsa a mio padre.",
    "de": "Gestern war ich mit meiner Schwester im Laden, weil wir Brot und Milch brauchten. Ich weiß nicht, was ich tun soll, wenn die Nacht kommt und ich nicht schlafen kann. Meine Mutter sagt, dass alles gut wird, aber ich bin sehr müde. Sonntags gehe ich durch den Park und danach koche ich etwas Einfaches. Seit das Semester angefangen hat, fällt es mir schwer, mich im Unterricht zu konzentrieren. Der Lehrer bat mich, die Arbeit vor Freitag abzugeben. Manchmal denke ich, dass niemand versteht, was mit mir los ist, obwohl meine Freunde mir helfen wollen. Ich höre gern Musik, während ich die Wohnung aufräume und die Wäsche wasche. Seit drei Monaten wohne ich allein in einer kleinen Wohnung am Fluss. Wenn es morgen regnet, bleibe ich im Bett und lese ein Buch. Ich habe meinem Vater noch nichts vom Geld erzählt.",
    "ru": "Вчера я ходила в магазин с сестрой, потому что нам были нужны хлеб и молоко. Я не знаю, что делать, когда наступает ночь и я не могу уснуть. Мама говорит, что всё будет хорошо, но я очень устала. По воскресеньям я гуляю в парке, а потом готовлю что-нибудь простое. С начала семестра мне трудно сосредоточиться на занятиях. Преподаватель попросил сдать работу до пятницы. Иногда мне кажется, что никто не понимает, что со мной происходит, хотя друзья стараются помочь. Я люблю слушать музыку, пока убираю квартиру и стираю бельё. Уже три месяца я живу одна в маленькой квартире у реки.",
    "zh": "昨天我和妹妹去了商店，因为我们需要面包和牛奶。到了晚上睡不着的时候，我不知道该怎么办。妈妈说一切都会好起来的，可是我非常累。星期天我在公园里散步，然后做一点简单的饭。开学以后，我上课很难集中注意力。老师让我在星期五以前交作业。有时候我觉得没有人明白我的情况，虽然朋友们都想帮助我。我喜欢一边听音乐一边打扫房间。三个月以来我一个人住在河边的小房子里。如果明天下雨，我就在床上看书。",
    "ja": "昨日、妹と一緒に店へ行きました。パンと牛乳が必要だったからです。夜になって眠れないとき、どうしたらいいか分かりません。母は全部うまくいくと言いますが、私はとても疲れています。日曜日は公園を散歩して、それから簡単な料理を作ります。学期が始まってから、授業に集中するのが難しいです。先生は金曜日までに宿題を出すように言いました。時々、誰も私のことを分かってくれないと思います。音楽を聴きながら部屋を片付けるのが好きです。三か月前から川の近くの小さな部屋に一人で住んでいます。",
    "ar": "ذهبت أمس إلى المتجر مع أختي لأننا كنا نحتاج إلى الخبز والحليب. لا أعرف ماذا أفعل عندما يأتي الليل ولا أستطيع النوم. تقول أمي إن كل شيء سيكون بخير، لكنني متعبة جدا. في يوم الأحد أمشي في الحديقة ثم أطبخ شيئا بسيطا. منذ بداية الفصل يصعب علي التركيز في الدروس. طلب مني الأستاذ أن أسلم العمل قبل يوم الجمعة. أحيانا أظن أن لا أحد يفهم ما يحدث لي. أحب أن أسمع الموسيقى وأنا أرتب البيت. أسكن وحدي منذ ثلاثة أشهر في شقة صغيرة قرب النهر.",
    "hi": "कल मैं अपनी बहन के साथ दुकान गई क्योंकि हमें रोटी और दूध चाहिए था। जब रात होती है और मुझे नींद नहीं आती, तो मुझे समझ नहीं आता कि क्या करूँ। माँ कहती हैं कि सब ठीक हो जाएगा, पर मैं बहुत थकी हुई हूँ। रविवार को मैं पार्क में टहलती हूँ और फिर कुछ आसान पकाती हूँ। जब से सत्र शुरू हुआ है, कक्षा में ध्यान लगाना मुश्किल है। शिक्षक ने शुक्रवार से पहले काम जमा करने को कहा। कभी-कभी लगता है कि कोई मेरी बात नहीं समझता। मुझे घर साफ करते हुए संगीत सुनना पसंद है।",
    "th": "เมื่อวานฉันไปร้านค้ากับน้องสาวเพราะเราต้องการขนมปังกับนม ฉันไม่รู้จะทำอย่างไรเมื่อถึงเวลากลางคืนแล้วนอนไม่หลับ แม่บอกว่าทุกอย่างจะดีขึ้นแต่ฉันเหนื่อยมาก วันอาทิตย์ฉันเดินเล่นในสวนแล้วก็ทำอาหารง่ายๆ ตั้งแต่เปิดเทอมฉันตั้งใจเรียนได้ยาก อาจารย์ให้ฉันส่งงานก่อนวันศุกร์ บางครั้งฉันคิดว่าไม่มีใครเข้าใจฉันเลย ฉันชอบฟังเพลงตอนที่เก็บบ้าน",
}
