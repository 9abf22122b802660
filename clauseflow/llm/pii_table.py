"""The labelled table that the field for personal data learns from: sentences written by rule.

Frames, names, streets and towns are everyday ones, or made up from syllables; none is taken from a corpus. A frame is
a line with {slots}; a slot is a value of a kind, a piece of filler, or a number that is no personal data.
Names of persons stand in any case of the language, in capitals, with posts and titles beside them.
"""

from __future__ import annotations

import random
import re

#: Sentences in the labelled table.
TABLE_ROWS = 20000

_MEN = "Александр Алексей Анатолий Андрей Антон Артём Борис Вадим Валерий Василий Виктор Виталий Владимир Владислав Вячеслав Геннадий Георгий Григорий Даниил Денис Дмитрий Евгений Егор Иван Игорь Илья Кирилл Константин Лев Леонид Максим Марк Матвей Михаил Никита Николай Олег Павел Пётр Роман Руслан Семён Сергей Станислав Степан Тимур Фёдор Эдуард Юрий Яков Ринат Арсен".split()
_WOMEN = "Александра Алина Алла Анастасия Анна Валентина Валерия Вера Вероника Виктория Галина Дарья Диана Евгения Екатерина Елена Жанна Зоя Инга Ирина Карина Кристина Ксения Лариса Лидия Любовь Людмила Маргарита Марина Мария Надежда Наталья Нина Оксана Ольга Полина Светлана София Тамара Татьяна Ульяна Элина Юлия Яна Гульнара".split()
_FATHERS = "Александров Алексеев Анатольев Андреев Антонов Борисов Вадимов Валерьев Васильев Викторов Витальев Владимиров Геннадьев Григорьев Денисов Дмитриев Евгеньев Иванов Игорев Кириллов Константинов Леонидов Максимов Михайлов Николаев Олегов Павлов Петров Романов Сергеев Степанов Фёдоров Эдуардов Юрьев Рашидов".split()
_SURNAMES = "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Фёдоров Морозов Волков Алексеев Лебедев Семёнов Егоров Павлов Козлов Степанов Николаев Орлов Андреев Макаров Никитин Захаров Зайцев Соловьёв Борисов Яковлев Григорьев Романов Воробьёв Сергеев Кузьмин Фролов Королёв Гусев Киселёв Ильин Максимов Поляков Сорокин Виноградов Ковалёв Белов Медведев Антонов Тарасов Жуков Баранов Филиппов Комаров Давыдов Беляев Герасимов Богданов Осипов Сидоров Матвеев Титов Марков Миронов Крылов Куликов Карпов Власов Мельников Денисов Гаврилов Тихонов Казаков Афанасьев Данилов Савельев Тимофеев Фомин Чернов Абрамов Мартынов Ефимов Щербаков Назаров Калинин Исаев Чернышёв Быков Маслов Родионов Коновалов Лазарев Воронин Климов Пономарёв Голубев Кудрявцев Прохоров Наумов Потапов Журавлёв Овчинников Трофимов Леонов Соболев Ермаков Колесников Гончаров Емельянов Никифоров Грачёв Котов Гришин Ефремов Архипов Громов Кириллов Малышев Панов Моисеев Румянцев Акимов Кондратьев Бирюков Горбунов Анисимов Ерёмин Тихомиров Галкин Лукьянов Михеев Скворцов Юдин Белоусов Нестеров Симонов Прокофьев Харитонов Князев Цветков Левин Митрофанов Воронов Аксёнов Софронов Мальцев Логинов Горшков Савин Краснов Майоров Демидов Елисеев Рыбаков Сафонов Плотников".split()
_ADJ_SURNAMES = "Покровский Каменский Островский Добровольский Вишневский Заболоцкий Дубровский Троицкий Соловецкий Рождественский Белый Толстой Черный Ясинский Полонский".split()
_FIXED_SURNAMES = "Шевченко Бондаренко Ткаченко Кравченко Лысенко Романенко Коваленко Марченко Сидоренко Павленко Руденко Черных Долгих Седых Дюма Шмидт Вебер Ким Цой Пак Ли Мельничук Бондарчук Савчук Адамович Гуревич Рабинович Мицкевич Кац Штерн Гайдай Дзюба Ахметзянов Ибрагимов Гаджиев Мамедов Саркисян Петросян Гогоберидзе Абашидзе".split()
_EN_FIRST = "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra Mark Margaret Donald Ashley Steven Kimberly Andrew Emily Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Timothy Stephanie Edward Rebecca Laura Helen Alice Oliver Harry Jack Sophie Grace Freya Ravi Priya Chen Omar Fatima".split()
_EN_LAST = "Smith Johnson Williams Brown Jones Garcia Miller Davis Martinez Hernandez Lopez Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Nelson Baker Hall Campbell Mitchell Carter Roberts Turner Phillips Parker Evans Edwards Collins Stewart Morris Murphy Cook Rogers Morgan Cooper Peterson Reed Bailey Bell Kelly Howard Ward Cox Richardson Wood Watson Brooks Bennett Gray Hughes Price Sanders Patel Ross Foster Powell Russell Sullivan Fisher Henderson Cole West Jordan Ellis Gibson O'Brien McDonald".split()
_EN_STEM = "Ash Black Brad Cald Clif Cran Dal Ever Far Gold Har Hay Kirk Lang Lin Mans New Nor Pres Red Rush Shel Stan Sut Thorn Wake Wal Win Wood Hart Brom Fen Hol Kes".split()
_EN_TAIL = "ley ton field ford wood well worth ham by man ridge more combe leigh mere dale stock by croft burn gate stead bourne".split()
_TOWNS = "Москва Казань Самара Тверь Рязань Тула Омск Томск Пермь Уфа Пенза Курск Орёл Псков Калуга Кострома Ярославль Вологда Архангельск Мурманск Саратов Волгоград Ростов-на-Дону Краснодар Ставрополь Нижний_Новгород Екатеринбург Челябинск Новосибирск Красноярск Иркутск Хабаровск Владивосток Санкт-Петербург Комсомольск-на-Амуре Набережные_Челны Великий_Новгород Сергиев_Посад".replace("_", " ").split(" ")
_ADJ_STREETS = "Советская Октябрьская Молодёжная Центральная Школьная Набережная Первомайская Комсомольская Московская Зелёная Солнечная Луговая Рабочая Спортивная Северная Южная Мира Парковая Трудовая Полевая Весенняя Станционная Вокзальная Новая Речная Большая Малая Нижняя Верхняя Тверская Преображенская Красноармейская Пролетарская Транспортная Дачная Озёрная".split()
_MEN_STREETS = "Ленина Гагарина Кирова Пушкина Гоголя Чехова Горького Калинина Мира Победы Космонавтов Строителей Труда Свободы Маяковского Лермонтова Тургенева Некрасова Суворова Жукова Королёва Циолковского Менделеева Ломоносова Чайковского Куйбышева Энергетиков Металлургов Ветеранов Декабристов".split()
_OBL_ADJ = ("ском", "ому")
_EN_STREETS = "High Church Station Victoria Park Queen King London Mill Bridge Oak Elm Maple Cedar Pine Main Washington Lincoln Baker Downing Fleet Oxford Regent Chapel Green Hill Lake River Spring Sunset Broad Market North South West Grove Albert Manor Castle Abbey Orchard Willow Meadow".split()
_EN_KINDS = "Street Road Lane Avenue Drive Close Court Square Place Way Crescent Terrace Boulevard St. Rd. Ave. St Ave".split()
_EN_TOWNS = "London Leeds York Bristol Oxford Cambridge Manchester Liverpool Boston Chicago Dallas Denver Seattle Austin Portland Albany Springfield Dublin Edinburgh Glasgow Cardiff Bath Chester Durham Exeter Derby".split()
_POSTS = "директор менеджер бухгалтер юрист инженер секретарь начальник заместитель специалист консультант администратор программист врач водитель кладовщик оператор мастер бригадир референт ревизор диспетчер методист архивист аналитик эксперт куратор технолог инспектор контролёр координатор".split()
_OF = "отдела управления цеха службы бюро департамента группы участка склада кафедры сектора центра".split()
_COMMON = "и в на по для с к от до при за о об не что как или а но также это все после перед без под над между через согласно включая".split()
_NOUNS = "положение порядок приказ отдел управление служба работа отчёт план договор документ контроль учёт срок право обязанность организация подразделение вопрос решение проект система данные материал товар склад закупка поставка продажа услуга клиент сторона заявка проверка оценка расчёт бюджет расход доход налог оплата счёт сумма цена рынок качество процесс этап задача функция цель область район город школа завод больница дорога поезд погода книга газета письмо встреча собрание совет комитет комиссия безопасность снабжение производство строительство образование хозяйство финансов персонала имущества кадров охраны труда рисков обеспечение подготовка согласование утверждение ведение хранение передача разработка выполнение участие".split()
_VERBS = "готовит ведёт утверждает рассматривает обеспечивает проверяет принимает направляет хранит выполняет участвует контролирует пришёл сказал написал подписал принял сдал получил уехал вернулся работает живёт просит сообщил передал открыл закрыл заверила приняла выдана выписан указан проверен оформлен записан прописана временный завтра сегодня утром вечером вчера весной снова пожалуйста".split()
_EN_NOUNS = "report plan contract office department committee board agreement project system data service client order payment account budget review approval process section policy procedure staff team meeting letter house garden shop weather train road risk control audit office quality supply store branch record file request change owner member page list".split()
_EN_VERBS = "approves reviews prepares keeps signs sends called moved joined opened closed wrote shipped applies covers shows works lives took is was has yesterday today soon again last next week open free".split()
_ROLES = "Пациент Пациентка Ученик Ученица Студент Студентка Гражданка Истец Ответчик Свидетель Продавец Покупатель Арендатор Жилец Сосед Соседка Нотариус Вахтёр Дежурный Председатель Секретарь Капитан Сержант Профессор Доцент Учитель Тренер Мастер Повар Курьер Получатель Отправитель Плательщик Наследник Опекун Представитель Автор Редактор Художник Директор Заведующий Заведующая Товарищ Господин Госпожа Доктор Коллега Участник Победитель Владелец Собственник".split()
_EN_COMMON = "the a of and in to for with on by from as at or is are was were be this that not any each all after before under over between".split()
_SITES = "mail post inbox firma company office corp study clinic bank server host web portal net group data north alpha metro city".split()
_ZONES = ".ru .com .org .net .рф .su .info .example .test .co.uk .edu .io .example.org .example.com .gov .biz .by".split()
_ORGS = "Ромашка Вектор Горизонт Прогресс Альфа Восход Меридиан Гранит Маяк Луч Сириус Каскад Феникс Энергия Техно Стандарт".split()
_MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()

# {person}, {phone}, {email}, {id} with the word that announces it, {address}: values; an e before a kind: English.
# {f} {ef}: filler words; {W} {EW}: a made-up name; {org}: a company; {post}: a post; {n5}: five digits; {code}: a code of a project or part.
_FRAMES = """
{person}
{person}, {post}
{Post} {person}
{post} {of} {person}
Заявитель: {person}
Ф.И.О.: {person}; {id}; {address}
Фамилия, имя, отчество {person}
Сотрудник {person} {f}.
Прошу {person:d} {f}.
Поручить {person:d} {f} до {date}.
Позвоните {person:d} {f}.
Назначить {person:g} на должность {post:g}.
Передайте документы {person:d}, {phone}.
Письмо от {person:g} {f}.
Встреча с {person:i} {f}.
В присутствии {person:g} и {person:g} {f}.
Благодарим {person:g} за {f}.
Уважаемый {person}!
Здравствуйте, {person}, {f}.
По поручению {person:g} {f} {f}.
Заказчик в лице {person:g}, действующего на основании {f}, и {person}.
Протокол вёл {person}. {F}.
Докладчик {person} {f}, содокладчик {person} {f}.
Подпись: {person} ({post})
Ответственный — {person} ({phone}).
Куратор проекта «{W}» {person} {f}.
Врач {person} принимает по адресу: {address}.
Г-н {person} {f}.
Госпоже {person:d} вручено {f}.
Гражданин {person}, {id}, зарегистрирован: {address}, {f}.
Паспортные данные: {id}
Сообщите {id} и {f}.
{Id}.
У работника {id}, {f}.
В договоре указан {id}; {f}.
Документ: {id}, выдан {date}.
{person}, {id}, тел. {phone}
Телефон: {phone}
Тел./факс {phone}, {email}
Моб. {phone} ({person})
Номер для связи {phone}.
Наберите {phone} и {f}.
Справки по телефону {phone}, {f}.
Звоните: {phone} или {phone}.
Горячая линия {phone} {f}.
{phone} — {f}
({phone})
Перезвонить на {phone} после {n2}:{n2}.
WhatsApp {phone}, почта {email}.
Контакты: {email}, {phone}, {address}
Почта: {email}
Эл. адрес {email}; {f}.
Пишите нам: {email}
{email}
{email} {f} {f}.
Отправьте {f} на {email}.
На ящик {email} поступило {f}.
Ящик ({email}) {f}.
Логин и адрес {email}, {f}
Вопросы — {email}, {person}.
Адрес: {address}
Адрес регистрации: {address}.
Проживает по адресу {address}, {f}.
Живёт {address}; {f}.
Доставка: {address}, {phone}.
Офис находится: {address}. {F}.
Место жительства {address}
Квартира расположена по адресу {address} и {f}.
Приезжайте: {address}; {f}.
{address}, получатель {person}
{address}
Переехал на {oaddress}, {f}.
Встречаемся на {oaddress} в {n2} часов.
Направить {f} ({address}) {f}.
Принял: {person}, {post}, {address}.
Опросили {person:g}, {person:g} и {person:g}.
Список: 1) {person}; 2) {person}; 3) {person}
{person} / {person}
Со слов {person:g} {f}, {phone}.
Утверждаю: {post} {person}
УТВЕРЖДАЮ {person:u}
({person:u})
Автор: {person:u}.
{Post} {person} поручил {f}, {person} {f}.
Договор подписали {person} и {person} {date}.
{Role} {person} {f}.
{Role} {person:g} {f}.
{Role} {person}, {f}.
{F} {person} {f}.
{F} {role} {person} {f}.
{F} у {person:g}, {f}.
{F} {person:d} {f}.
{F} на имя {person:g} {f}.
На имя {person:g} {f}.
{Fw} {person}, {f}.
{F} {phone}, {f}.
{F} {phone} {f}.
Мой {fw} {phone}, {f}.
{Fw}: {phone}.
{F} {email} {f}.
{F} на {email}, {f}.
{F} {id} {f}.
{F} {id}, {f}.
У него {id} и {f}.
Предъявлен {id} {f}.
{Id} {f}.
{F} {address}, {f}.
{F} {address} {f}.
{F} с {address} {f}.
{F}: {address}, {f}.
{F} в {address}, {f}.
{F} на {oaddress} {f}.
{F} на {oaddress}, {f}.
{Fw} {fw}: {address}.
{person} {f}.
{person} {f}, {f}.
{F} на имя {person}, {id}, {address}.
{F}, {person}, {id}, {oaddress}.
{F} ({email}) {f}.
{F} ({email}), {f}.
{F} {id}, {address}.
{person}, {id}, {address}.
{F} {person:g}, {id}, {address}, {f}.
{Id}; {fw}: {address}.
{Fw} {fw} {fw}: {person}.
{Fw} {person:g} {f}.
{Fw} {fw} {person} {f}.
""".strip().splitlines()

_EN_FRAMES = """
{eperson}
Dear Mr. {eperson},
Dear Mrs. {eperson}, {ef}.
Dr. {eperson} {ef}.
Ms {eperson} called from {ephone}.
From: {eperson} <{email}>
Please ask {eperson} {ef}.
{eperson} and {eperson} {ef}.
{eperson}, {epost}, {ef}.
Name: {eperson}, {eid}
The {epost}, {eperson}, {ef}.
According to {eperson}, {ef}.
Prepared by {eperson} on {edate}.
Tenant {eperson} of {eaddress} {ef}.
Sincerely, {eperson}
Phone: {ephone}
Tel. {ephone}, fax {ephone}
Mobile {ephone}; {ef}.
Dial {ephone} {ef}.
You can reach us at {ephone} or {email}.
Text {ephone} {ef}.
Our hotline {ephone} {ef}.
E-mail: {email}
Reply to {email} {ef}.
{Ef} {email} {ef}.
{email} {ef}.
Forward the {ef} to {eemail} by {edate}.
Write to {eemail}.
{eemail} {ef}.
Address: {eaddress}
Ship it to {eaddress}.
She lives at {eaddress}, {ef}.
Our office is at {eaddress}. {Ef}.
Parcels for {eperson} go to {eaddress}.
Deliver to {eaddress}, phone {ephone}.
Visit {eaddress} {ef}.
{eaddress}
His {eid} {ef}.
{eperson} has {eid}.
Applicant {eperson}: {eid}, {ephone}.
Record shows {eid}.
Provide {eid} {ef}.
Attn. {eperson}, {eaddress}
Mr {eperson} {ef}.
Mrs {eperson}, {ef}.
Miss {eperson} {ef}.
Professor {eperson} {ef}.
{Ef} {eperson} {ef}.
{Ef} with {eperson} {ef}.
{Ef} by {eperson}, {ef}.
{Ef} to Mr {eperson} {ef}.
{eperson} {ef}.
{Ef} at {eaddress} {ef}.
{Ef} to {eaddress} {ef}.
{Ef} is {eaddress} and {ef}.
{Ef}: {eaddress}.
The {ef} at {eaddress} {ef}.
{Ef} {ephone} {ef}.
{Ef} on {ephone} {ef}.
{Ef}: {ephone}.
{Ef} {eid} {ef}.
{Ef} {eid}, {ef}.
{Ef} {eemail} {ef}.
{Ew} {eperson} {ef}.
{Ef} ({email}) {ef}.
{Ef} ({eemail}) {ef}.
{Verb} {eperson}, {ef}.
{Verb} {eperson} {ef}.
{Verb} {eperson}, {ew} {ephone} {ef}.
{Ew} {ew} {eperson} {ef}.
{Ew} {ew}: {eaddress}.
""".strip().splitlines()

_NONE = """
{F}.
{F}, {f}.
{F}, {f}, {f}.
{n1}.{n1}. {F};
{n1}.{n1}.{n1}. {F} {f}.
- {f};
а) {f};
{CAPS}
{CAPS} {CAPS}
Глава {n1}. {F}
Раздел {n1}. {F} {f}
Статья {n2}. {F}
Приложение № {n1} к приказу от {date} № {n3}
В соответствии с пунктом {n1}.{n1} {f} {f}.
См. пункты {n1}.{n1}.{n1}, {n1}.{n2} и {n2}.
{Post} {of} {f} {f}.
{Post} {f}, {f} и {f}.
{Post} «{W}» {f}.
Начальник управления «{W}» {f} {f}.
Договор № {n2}/{n4} от {date} {f}.
Контракт {n6}-{n2} {f}.
Договор {n3}-{n5}, счёт {n20}.
Счёт № {n20} в банке «{org}».
Р/с {n20}, БИК {n9}, к/с {n20}
ИНН {n10}, КПП {n9}, ОГРН {n13}
{org}, ИНН {n10}, {f}.
Артикул {n7}, партия {n4}-{n3}, {n2} шт.
Товар {n8} {f} {n3} кг.
Серийный номер {code}, инв. № {n9}.
Код {code} {f}.
Проект {code} и система {code} {f}.
Объект {W}-{n3}, контур {W}-{n4} и {W}-{n2} {f}.
По картам {W}-{n3}, {W}-{n4} {f} {f} «{W}».
Программа «{W}» {f} {W} {f}.
Площадки {W}, {W} и {W} {f}.
{F} {W} {f}, {W} {f}.
Итоги в {W}-{n2}, {W}-{n4}; {f}.
Сумма {n3} {n3} рублей {n2} копеек.
Стоимость {n2} {n3} {n3},{n2} руб. {f}.
Итого: {n1} {n3} {n3} {n3}
От {n3} до {n4} единиц {f}.
Показания {n3} {n3} {n2} {f}.
Срок — {n2} {f} {n2}.{n2}.20{n2}.
В {n2}:{n2} {f} {date}.
{date} {f}.
Стр. {n3}
с. {n2} из {n3}
т. {n1}, д. {n2}, л. {n3} {f}
Номер заявки {n8}, номер накладной {n6}.
Версия {n1}.{n1}.{n2}, сборка {n5}.
Протокол {n2}-{n2}/{n4}.
Штрихкод {n13}.
Телефон {f} {f}.
Телефонная книга {f}; паспорт изделия {code} {f}.
Почта {f} и адрес {f} {f}.
Паспорт объекта № {n4} {f}.
Улица {f} {f} {f}.
Дом культуры, {f}, {f}.
Город {W} и {W} {f}.
Сторона «{org}» {f}.
{org} и {org} {f}.
Компания {org} ({f}) {f}.
Каталог @{lat} и тег #{lat} {f}.
Скидка {n2}% @ {n3} {f}.
{F} SQL, {f} KPI {f}.
{F} API и {CAPS} {f}.
В {W}ской области {f} {n2} {f}.
{F} в {W}ском районе {f}.
{F} из {W}ска {f}.
{HEAD}
{HEAD}
{HEAD} {CAPS}
Изделие {code} и {f} {code} {f}.
Счёт-фактура {n6} от {date} {f}.
Договор № {n2}/{n4}-К {f}, счёт {n20} {f}.
{F} в {W} {f}.
{Fw} {n6} и {f} № {n2}-{n2} {f}.
{F} {n7} {f}.
{F} {W}-{n3}.
{F} {W}. {F} {W}.
{F} {W}. {F}.
{F} {W}-{n4}, {f}.
{F} {W}-{n2} {f} {W}-{n3}.
{F} ({f} {W}-{n4}, {W}-{n3}).
{F} ({fw} {W}-{n3}), {f}.
{F} {fw} {W}-{n3}, {W}-{n4} и {W}-{n3}; {f}.
{F} в {fw} {W}-{n3}, {f} {f}.
{F} для {fw} {W}-{n4}, {W}-{n2}, {W}-{n3} {f}.
{F} {fw} {W}-{n3} с {fw} в {W}-{n4}.
{F} {fw} {lw}-{n3} ({fw} {lw}-{n4}) {f}.
{CAPS}, {CAPS}, {CAPS}
{CAPS} {W}-{n3}, {CAPS}
{CAPS} ({CAPS}) {CAPS}.
{HEAD}, {CAPS} {HEAD}
{HEAD} «{W}-{n3}» {CAPS}
{Role} {f} {f}.
{Role} {of} {f}.
""".strip().splitlines()

_EN_NONE = """
{Ef}.
{Ef}, {ef}.
{Ef}, {ef} and {ef}.
{n1}.{n1} {Ef}.
Section {n1}.{n1}: {Ef}.
See clause {n1}.{n1} {ef}.
Invoice {n7} {ef}.
Order no. {n8}, batch {n3}-{n4}.
Contract {n2}/{n5} {ef}.
Account {n10} {ef}.
Part {code} {ef}.
Project {code} {ef}.
Office {EW}-{n3} and plant {EW}-{n2} {ef}.
Programme {EW} {ef}.
The {EW} {EW} project {ef}.
Register {EW}-{n4} {ef}.
The {epost} {ef}.
The Board {ef} and the Committee {ef}.
Ask when The Office {ef}.
Total {n3} {n3}, {ef}.
{Ef} from {n3} {n3} to {n3} {n4}.
Version {n1}.{n2}.{n1} {ef}.
Serial number {code}.
Page {n2} of {n3}
{edate}: {ef}.
Phone {ef}, email {ef}.
Passport control {ef}.
Street lights {ef}, {ef}.
{Ef} KPI {ef}, {ef} ETL {ef}.
{ECAPS} {ECAPS}
{Ef} to {Ew} {EN}.
{Ef} in {EN} {EN} {ef}.
{Ef} {EW}-{n3}, {ef} {EW}-{n4}.
{Ef} {EW}. {Ef}.
{Ef} {EN} {EW}. {Ef} {EW}.
{Ef} {EW}. The {ef}.
{Ew} {n2}-{n4} and {ew} {n6} {ef}.
{Ew} {n8} {ef} {n2}-{n3}-{n2}.
{Ef} ({ew} {EW}-{n3}, {EW}-{n2}) {ef}.
{ECAPS} {ECAPS}, {ECAPS}
{Verb} {ef} {ef}.
The {EN} of {EN} {ef}.
{Ef} the {EN} {EN} {EN} {ef}.
""".strip().splitlines()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _word(r: random.Random, n: int, cyr: bool = True) -> str:
    a, b, c = ("бвгджзклмнпрстфхчшщ", "аеиоуыюя", "лмнрстхк") if cyr else ("bcdfghklmnprstvwz", "aeiouy", "lmnrstkd")
    return "".join((r.choice(a) if r.random() < 0.9 else "") + r.choice(b) + (r.choice(c) if r.random() < 0.3 else "") for _ in range(n))


_ENDS = "ие ия ий ов ам ами ых их ный ная ное ные ного ный ность ости ение ения ании ация ации ет ит ют ует ать ить ка ки ку ок ый ой ом ем ах ях".split()
_EN_ENDS = "s ed al ing ory tion ment ive ly er able ness ity ance".split()


def _filler(r: random.Random, cyr: bool) -> str:
    out = []
    for _ in range(r.randrange(1, 6)):
        x = r.random()
        if x < 0.3:
            out.append(r.choice(_COMMON if cyr else _EN_COMMON))
        elif x < 0.55:
            out.append(r.choice(_NOUNS if cyr else _EN_NOUNS))
        elif x < 0.7:
            out.append(r.choice(_VERBS if cyr else _EN_VERBS))
        else:
            out.append(_word(r, r.choice((1, 2, 2, 3, 3)), cyr) + (r.choice(_ENDS if cyr else _EN_ENDS)))
    return " ".join(out)


# Endings by case: genitive, dative, instrumental, prepositional.
def _declined(word: str, female: bool, case: str, surname: bool = False) -> str:
    at = "gdip".find(case)
    if at < 0:
        return word
    if surname and word.endswith(("ова", "ева", "ёва", "ина", "ына")):
        return word[:-1] + ("ой", "ой", "ой", "ой")[at]
    if word.endswith(("ская", "цкая", "ая")):
        return word[:-2] + "ой"
    if word.endswith(("ский", "цкий", "ый", "ой")) and surname:
        return word[:-2] + ("ого", "ому", "им" if word[-3] in "кг" else "ым", "ом")[at]
    if surname and (female or word.endswith(("о", "их", "ых", "и", "е"))):
        return word
    if word.endswith("а"):
        return word[:-1] + ("и" if word[-2] in "гкхжшчщ" else "ы", "е", "ой", "е")[at]
    if word.endswith("ия"):
        return word[:-1] + ("и", "и", "ей", "и")[at]
    if word.endswith("я"):
        return word[:-1] + ("и", "е", "ей", "е")[at]
    if word.endswith("й"):
        return word[:-1] + ("я", "ю", "ем", "е")[at]
    if word.endswith("ь"):
        return word[:-1] + (("и", "и", "ью", "и") if female else ("я", "ю", "ем", "е"))[at]
    if word.endswith(("ов", "ев", "ёв", "ин", "ын")) and surname:
        return word + ("а", "у", "ым", "е")[at]
    return word + ("а", "у", "ем" if word[-1] in "чшжщц" else "ом", "е")[at]


def _surname(r: random.Random, female: bool) -> str:
    x = r.random()
    if x < 0.35:
        s = r.choice(_SURNAMES)
    elif x < 0.43:
        s = r.choice(_ADJ_SURNAMES)
    elif x < 0.55:
        return r.choice(_FIXED_SURNAMES)
    elif x < 0.92:
        s = _word(r, r.choice((1, 2, 2, 3))).capitalize() + r.choice("кмнсрлтдвбгз") + r.choice(("ов", "ев", "ин", "ский", "ов", "ин"))
    else:
        return _word(r, r.choice((1, 2, 2))).capitalize() + r.choice("кмнсрлтд") + r.choice(("енко", "ук", "ич", "ян", "дзе", "ко", "юк", "ль", "ер", "ец"))
    if s.endswith(("ов", "ев", "ёв", "ин", "ын")):
        s += "а" if female else ""
    elif s.endswith(("ий", "ый", "ой")) and female:
        s = s[:-2] + "ая"
    if r.random() < 0.04:
        s += "-" + r.choice(_SURNAMES) + ("а" if female else "")
    return s


def _person(r: random.Random, case: str = "") -> str:
    female = r.random() < 0.5
    first, last = r.choice(_WOMEN if female else _MEN), _surname(r, female)
    if r.random() < 0.15:  # a given name of no list
        first = _word(r, 2).capitalize() + (r.choice(("а", "я", "ия", "на")) if female else r.choice(("н", "р", "й", "с", "м", "л")))
    father = r.choice(_FATHERS) + ("на" if female else "ич")
    i, j = first[0] + ".", r.choice("АБВГДЕИКЛМНОПРСТФЮЯ") + "."
    if "-" not in last:
        last = _declined(last, female, case, True)
    f, o = _declined(first, female, case), _declined(father, female, case)
    s = r.choice((
        f"{last} {f} {o}", f"{last} {f} {o}", f"{f} {o} {last}", f"{f} {o}", f"{f} {last}", f"{f} {last}", f"{last} {f}", f"{i}{j} {last}", f"{i} {j} {last}",
        f"{last} {i}{j}", f"{last} {i} {j}", f"{i} {last}", f"{last} {i}", f"{i}{last}" if r.random() < 0.3 else f"{i}{j}{last}",
    ))
    return s.upper() if case == "u" or r.random() < 0.03 else s


def _eperson(r: random.Random, case: str = "") -> str:
    first = r.choice(_EN_FIRST) if r.random() < 0.75 else _word(r, 2, False).capitalize() + r.choice("nlras")
    last = r.choice(_EN_LAST) if r.random() < 0.5 else r.choice(_EN_STEM) + r.choice(_EN_TAIL)
    if r.random() < 0.12:
        first, last = _word(r, 2, False).capitalize(), _word(r, 2, False).capitalize() + r.choice(("ov", "ova", "in", "sky", "enko", "ev"))
    mid = r.choice("ABCDEFGHJKLMNPRSTW") + "."
    s = r.choice((f"{first} {last}", f"{first} {last}", f"{first} {mid} {last}", f"{first[0]}. {last}", f"{first[0]}. {mid} {last}", f"{first[0]}.{mid} {last}", f"{last}, {first}", f"{last} {first[0]}."))
    return s.upper() if r.random() < 0.03 else s


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    code, a, b, c = d(3), d(3), d(2), d(2)
    sep = r.choice(("-", "-", " ", "."))
    s = r.choice((
        f"+7 {code} {a} {b} {c}", f"+7 ({code}) {a}{sep}{b}{sep}{c}", f"+7({code}){a}{sep}{b}{sep}{c}", f"8 ({code}) {a}{sep}{b}{sep}{c}", f"8({code}){a}{b}{c}", f"8{code}{a}{b}{c}", f"+7{code}{a}{b}{c}",
        f"8-{code}-{a}-{b}-{c}", f"8-{code}-{a}-{b}{c}", f"8 {code} {a}{sep}{b}{sep}{c}", f"+7-{code}-{a}-{b}-{c}", f"({code}) {a}{sep}{b}{sep}{c}", f"{a}-{b}-{c}", f"8 800 {a} {b} {c}", f"+375 {d(2)} {a}-{b}-{c}", f"7 {code} {a} {b} {c}", f"8 {d(4)} {d(2)}-{b}-{c}",
    ))
    return s + (r.choice((" доб. ", " доб.", ", доб. ", " вн. ", " (доб. ")) + d(r.choice((2, 3, 4))) if r.random() < 0.22 else "")


def _ephone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    s = r.choice((
        f"+44 20 {d(4)} {d(4)}", f"+44 {d(4)} {d(6)}", f"0{d(4)} {d(6)}", f"020 {d(4)} {d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}",
        f"+1 {d(3)} {d(3)} {d(4)}", f"1-800-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}", f"001 {d(3)} {d(3)} {d(4)}", f"+49 {d(2)} {d(7)}", f"{d(3)}-{d(4)}", f"+353 {d(1)} {d(3)} {d(4)}",
    ))
    return s + (r.choice((" ext. ", " ext ", ", ext. ")) + d(r.choice((2, 3, 4))) if r.random() < 0.18 else "")


def _user(r: random.Random) -> str:
    a, b = _word(r, r.choice((1, 2, 2, 3)), False), _word(r, 2, False)
    return r.choice((a, a, f"{a}.{b}", f"{a[0]}.{b}", f"{a[0]}_{b}", f"{a}_{b}", f"{a}-{b}", f"{a}{_digits(r, 2)}", f"{a}{_digits(r, 4)}", f"{a}+{b}", f"{a}.{b[0]}", f"{b}.{_digits(r, 2)}", f"{a}+{r.choice(('docs', 'news', 'info'))}", r.choice(("info", "office", "support", "hr", "mail", "sales", "admin"))))


def _email(r: random.Random) -> str:
    host = (r.choice(_SITES) if r.random() < 0.4 else _word(r, 2, False)) + r.choice(("", "", "", "-" + r.choice(_SITES), "." + r.choice(_SITES))) + r.choice(_ZONES)
    s = _user(r) + r.choice(("@",) * 10 + (" @ ", " [at] ", "[at]", "(собака)", " (собака) ", "(at)", " (at) ", "＠")) + host
    x = r.random()
    return s.upper() if x < 0.06 else s.replace("@", " @ ") if x < 0.09 and " @" not in s else s


def _eemail(r: random.Random) -> str:
    host = (r.choice(_SITES) if r.random() < 0.4 else _word(r, 2, False)) + r.choice(("", "", "-" + r.choice(_SITES))) + r.choice(_ZONES)
    sign, dot = r.choice(((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" [at] ", "."), ("@", ".")))
    return _user(r) + sign + host.replace(".", dot)


def _id(r: random.Random) -> tuple[str, str]:
    d = lambda n: _digits(r, n)
    word, value = r.choice((
        (r.choice(("ИНН", "ИНН", "инн", "ИНН физлица", "номер ИНН")), r.choice((d(12), d(12), f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}"))),
        (r.choice(("СНИЛС", "СНИЛС", "снилс", "страховой номер", "СНИЛС №")), r.choice((d(11), f"{d(3)}-{d(3)}-{d(3)} {d(2)}", f"{d(3)}-{d(3)}-{d(3)}-{d(2)}", f"{d(3)} {d(3)} {d(3)} {d(2)}"))),
        (r.choice(("паспорт", "паспорт", "паспорт РФ", "паспорт серия", "паспорт серии", "серия", "паспорт гражданина")), r.choice((f"{d(2)} {d(2)} {d(6)}", f"{d(4)} {d(6)}", f"{d(4)} № {d(6)}", f"{d(4)} №{d(6)}", f"{d(2)} {d(2)} № {d(6)}"))),
    ))
    return word + r.choice((" ", " ", ": ", " – ")), value


def _eid(r: random.Random) -> tuple[str, str]:
    d = lambda n: _digits(r, n)
    ab = lambda n: "".join(r.choice("ABCEGHJKLMNPRSTWXYZQ") for _ in range(n))
    word, value = r.choice((
        (r.choice(("SSN", "SSN", "social security number", "Social Security no.")), r.choice((f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}"))),
        (r.choice(("passport no.", "passport", "passport number", "Passport No")), r.choice((d(9), f"{ab(2)}{d(7)}", f"{ab(1)}{d(8)}", f"{ab(2)} {d(7)}"))),
        (r.choice(("national insurance number", "NI number", "NINO", "insurance no.")), r.choice((f"{ab(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{ab(2)}{d(6)}{r.choice('ABCD')}"))),
        (r.choice(("taxpayer number", "TIN", "tax ID")), r.choice((f"{d(3)}-{d(2)}-{d(4)}", d(12), f"{d(3)} {d(3)} {d(3)}"))),
    ))
    return word + r.choice((" ", " ", ": ")), value


def _town(r: random.Random) -> str:
    if r.random() < 0.4:
        return r.choice(_TOWNS).replace(" ", " ")
    w = _word(r, r.choice((1, 2, 2))).capitalize() + r.choice(("ск", "град", "ово", "горск", "инск", "ино", "ево", "поль", "бург", "ка", "ь", "товск"))
    return r.choice((w, w, w, w, w + "-" + r.choice(("Южный", "Северный", "Центральный")), w + "-на-" + r.choice(("Дону", "Реке", "Волге", "Озере")), r.choice(("Новый ", "Старый ", "Верхний ", "Нижний ", "Малый ")) + w))


def _street(r: random.Random, male: bool = False) -> str:
    x = r.random()
    if male:  # beside a masculine word: the prospekt, the lane
        if x < 0.4:
            return r.choice(_MEN_STREETS)
        return r.choice(_ADJ_STREETS).removesuffix("ая") + "ый" if x < 0.5 else _word(r, r.choice((1, 2))).capitalize() + r.choice("кнлмр") + r.choice(("ский", "ный", "овый", "евой", "ый", "ий"))
    if x < 0.3:
        return r.choice(_ADJ_STREETS)
    if x < 0.55:
        return r.choice(_MEN_STREETS)
    if x < 0.62:
        return f"{r.randrange(1, 12)}-я " + r.choice(_ADJ_STREETS)
    if x < 0.68:
        return r.choice(("академика ", "маршала ", "генерала ", "Большая ", "имени ")) + r.choice(_MEN_STREETS)
    return _word(r, r.choice((1, 2))).capitalize() + r.choice("кнлмр") + r.choice(("ная", "ская", "овая", "ая", "истая", "енная", "ина", "ова"))


def _house(r: random.Random) -> str:
    n, m = r.randrange(1, 200), r.randrange(1, 300)
    h = str(n) + r.choice(("",) * 6 + ("а", "Б", f"/{r.randrange(1, 30)}", "-а"))
    x = r.random()
    if x < 0.25:
        return f", {h}" + r.choice(("", f"-{m}", f", кв. {m}", f", {m}", ""))
    s = r.choice((", д. ", ", дом ", ", д.", " д. ", ", дом № ")) + h
    s += r.choice(("",) * 5 + (f", корп. {r.randrange(1, 9)}", f", к. {r.randrange(1, 9)}", f", стр. {r.randrange(1, 9)}", f", строение {r.randrange(1, 9)}", f" корпус {r.randrange(1, 9)}"))
    return s + r.choice(("", "", f", кв. {m}", f", квартира {m}", f", кв.{m}", f", оф. {m}", f" кв. {m}", f", офис {m}", f", под. {r.randrange(1, 9)}"))


def _address(r: random.Random) -> str:
    post = r.choice("123456") + _digits(r, 5) if r.random() < 0.85 else _digits(r, 6)
    lane = _street(r, True)
    road = r.choice((
        f"ул. {_street(r)}", f"ул. {_street(r)}", f"ул. {_street(r)}", f"улица {_street(r)}", f"{_street(r)} ул.", f"{_street(r)} улица", f"ул.{_street(r)}", f"пр. {lane}", f"пр-т {lane}", f"проспект {lane}", f"{lane} проспект", f"просп. {lane}",
        f"пер. {lane}", f"переулок {lane}", f"{lane} пер.", f"бул. {lane}", f"бульвар {lane}", f"наб. {_street(r)}", f"набережная {_street(r)}", f"пл. {_street(r)}", f"ш. {lane}", f"{lane} шоссе", f"мкр. {lane}", f"микрорайон {lane}", f"проезд {lane}", f"тупик {lane}", f"{_street(r)}",
    ))
    t = _town(r)
    place = r.choice((f"г. {t}, ", f"г. {t}, ", f"г.{t}, ", f"город {t}, ", f"{t}, ", f"с. {t}, ", f"пос. {t}, ", f"дер. {t}, ", f"п. {t}, ", f"ст. {t}, "))
    region = r.choice(("",) * 6 + (f"{_word(r, 2).capitalize()}ская обл., ", f"{_word(r, 2).capitalize()}ская область, ", f"{_word(r, 2).capitalize()}ский р-н, ", f"{_word(r, 2).capitalize()}ский край, "))
    head = r.choice(("", "", "", place, place, f"{post}, {region}{place}", f"{post}, {place}", f"{region}{place}", f"{post} {place}", f"{post}, "))
    if not head and road[0] not in "упбнмш" and "ул" not in road and "про" not in road and "пер" not in road:
        head = place
    s = head + road + _house(r)
    if r.random() < 0.08 and head:  # flat first, as some write it
        s = r.choice((f"кв. {r.randrange(1, 200)}, ", f"д. {r.randrange(1, 99)}, ")) + road + ", " + place.rstrip(", ")
    if r.random() < 0.1:
        s = s.replace(". ", ".")
    if r.random() < 0.04:
        s = s.replace(", ", ",")
    return s


def _oaddress(r: random.Random) -> str:
    road = r.choice((f"{_word(r, 2).capitalize()}ском проспекте", f"{_word(r, 2).capitalize()}ской улице", f"улице {r.choice(_MEN_STREETS)}", f"проспекте {r.choice(_MEN_STREETS)}", f"{_word(r, 2).capitalize()}ном бульваре", f"{r.choice(_ADJ_STREETS)[:-2]}ой улице", f"{_word(r, 2).capitalize()}ском шоссе", f"площади {r.choice(_MEN_STREETS)}", f"{_word(r, 2).capitalize()}ской набережной"))
    return road + r.choice((f", {r.randrange(1, 200)}", f", д. {r.randrange(1, 200)}", f", дом {r.randrange(1, 200)}", f", {r.randrange(1, 200)}, кв. {r.randrange(1, 99)}"))


def _eaddress(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    name = r.choice(_EN_STREETS) if r.random() < 0.5 else r.choice((_word(r, 2, False).capitalize() + r.choice(("s", "", "er", "on")), r.choice(_EN_STEM) + r.choice(_EN_TAIL), r.choice(_EN_STREETS) + " " + r.choice(_EN_STREETS), "Old " + r.choice(_EN_STREETS)))
    house = str(r.randrange(1, 400)) + r.choice(("",) * 6 + ("A", "B", "C", f"-{r.randrange(1, 40)}"))
    road = f"{house} {name} {r.choice(_EN_KINDS)}" + r.choice(("",) * 8 + (" NW", " East"))
    town = r.choice(_EN_TOWNS) if r.random() < 0.5 else r.choice(("", "", "Port ", "New ", "East ")) + r.choice(_EN_STEM) + r.choice(_EN_TAIL)
    code = r.choice((f"{r.choice('BCELMNSW')}{r.choice('ABDEHLNS')}{d(1)} {d(1)}AB", f"{r.choice('ENSW')}{d(2)} {d(1)}{r.choice('ABDE')}{r.choice('FGHJ')}", f"{r.choice(('NY', 'CA', 'TX', 'IL'))} {d(5)}"))
    s = road + r.choice(("", f", {town}", f", {town}", f", {town}, {code}", f", {town} {code}", f", {town}, {code}"))
    return r.choice(("",) * 4 + (f"Flat {r.randrange(1, 250)}, ", f"Apt {r.randrange(1, 90)}, ", f"Unit {r.randrange(1, 90)}, ")) + s.rstrip(".")


def _code(r: random.Random) -> str:
    return r.choice((f"{_word(r, 1, False).upper()}-{_digits(r, 4)}", f"{_word(r, 2).capitalize()}-{_digits(r, 3)}", f"{_word(r, 1).upper()}-{_digits(r, 3)}/{_digits(r, 2)}", f"00{_digits(r, 6)}/{_digits(r, 2)}", f"{_digits(r, 5)}-{_digits(r, 3)}", f"{_word(r, 2, False).capitalize()}{_digits(r, 2)}"))


def _made(r: random.Random, cyr: bool = True) -> str:
    return _word(r, r.choice((2, 2, 3)), cyr).capitalize() + (r.choice(("", "ар", "он", "ит", "ель", "а", "ск", "зар")) if cyr else r.choice(("", "n", "r", "s")))


def _slot(r: random.Random, name: str) -> list[tuple[str, str]]:
    name, _, case = name.partition(":")
    low = name[0].lower() + name[1:]
    values = {"person": _person, "eperson": _eperson}
    plain = {
        "phone": (_phone, "phone"), "ephone": (_ephone, "phone"), "email": (_email, "email"), "eemail": (_eemail, "email"),
        "address": (_address, "address"), "oaddress": (_oaddress, "address"), "eaddress": (_eaddress, "address"),
    }
    if name in values:
        return [(values[name](r, case), "person")]
    if name in plain:
        make, kind = plain[name]
        return [(make(r), kind)]
    if low in ("id", "eid"):
        before, value = (_id if low == "id" else _eid)(r)
        return [(before[0].upper() + before[1:] if name[0] == "I" else before, ""), (value, "id_number")]
    if name[0] == "n":
        return [(_digits(r, int(name[1:])), "")]
    out = {
        "f": lambda: _filler(r, True), "F": lambda: _filler(r, True).capitalize(), "ef": lambda: _filler(r, False), "Ef": lambda: _filler(r, False).capitalize(),
        "lw": lambda: _made(r).lower(), "Verb": lambda: r.choice("Contact Call Ask Tell See Email Meet Visit Phone Write Send Inform Notify".split()), "ew": lambda: _filler(r, False).split()[0], "Ew": lambda: _filler(r, False).split()[0].capitalize(), "EN": lambda: (r.choice(_EN_NOUNS) if r.random() < 0.7 else r.choice(_EN_STREETS)).capitalize(), "fw": lambda: _filler(r, True).split()[0], "Fw": lambda: _filler(r, True).split()[0].capitalize(), "role": lambda: r.choice(_ROLES).lower(), "Role": lambda: r.choice(_ROLES), "HEAD": lambda: " ".join(r.choice(_NOUNS + ["И", "О", "ПО", "В"]) for _ in range(r.randrange(2, 6))).upper(),
        "CAPS": lambda: _filler(r, True).upper(), "ECAPS": lambda: _filler(r, False).upper(), "W": lambda: _made(r), "EW": lambda: _made(r, False), "code": lambda: _code(r), "lat": lambda: _word(r, 2, False),
        "org": lambda: r.choice(("ООО", "АО", "ЗАО", "ПАО", "ИП")) + f" «{r.choice(_ORGS) if r.random() < 0.5 else _made(r)}»", "post": lambda: r.choice(_POSTS) + ("у" if case == "d" else ""), "Post": lambda: r.choice(_POSTS).capitalize(), "of": lambda: r.choice(_OF),
        "epost": lambda: r.choice(("manager", "accountant", "lawyer", "engineer", "director", "clerk", "auditor", "officer", "secretary", "analyst")),
        "date": lambda: r.choice((f"{_digits(r, 2)}.{_digits(r, 2)}.20{_digits(r, 2)}", f"{r.randrange(1, 31)} {r.choice(_MONTHS)} 20{_digits(r, 2)} г.", f"{r.randrange(1, 31)} {r.choice(_MONTHS)}")),
        "edate": lambda: r.choice((f"{_digits(r, 2)}/{_digits(r, 2)}/20{_digits(r, 2)}", f"{r.choice(('May', 'June', 'March', 'October', 'Monday', 'Friday'))} {r.randrange(1, 31)}")),
    }[name]()
    return [(out, "")]


def labelled(rows: int = TABLE_ROWS, seed: int = 11) -> list[list[tuple[str, str]]]:
    """The labelled table: texts of one to four sentences as pieces (text, kind or '')."""
    r = random.Random(seed)
    out = []
    for _ in range(rows):
        pieces: list[tuple[str, str]] = []
        english = r.random() < 0.3
        for _ in range(r.choice((1, 2, 2, 3, 4))):
            pieces.append((r.choice(("", "", "", f"{r.randrange(1, 12)}.{r.randrange(1, 30)}. ", f"{r.randrange(1, 30)}. ", f"{r.randrange(1, 9)}) ", "– ", "• ", "— ")), ""))
            good = r.random() < 0.55
            frame = r.choice((_EN_FRAMES if good else _EN_NONE) if english else (_FRAMES if good else _NONE))
            for part in re.split(r"(\{[\w:]+\})", frame):
                pieces += _slot(r, part[1:-1]) if part.startswith("{") else [(part, "")]
            pieces.append((r.choice((" ", " ", " ", "\n", "\n", "\r\n", "  ", "\n\n", "\t")), ""))
        if r.random() < 0.08:
            pieces = [(t.replace(" ", "  ") if not k else t.replace(" ", " ") if r.random() < 0.3 else t, k) for t, k in pieces]
        out.append(pieces)
    return out
