"""Slip texts with known fields."""
HEAD = "Utb"
SENDER = "นาย ณัฐชัย รักษาวงษ์"
SENDER_ACC = "XXX-X-XX558-9"


def slip(*lines):
    return "\n".join(lines)


GOLDEN = {
    "full": (slip("Utb", "b", "b", "โอนเงินสําเร็จ", "16 ส.ค. 68, 19:18 น.", "10,000.00", "ค่าธรรมเนียม 0.00", SENDER,
                  SENDER_ACC, "ttb", "หนี ยอด 20,000 (1)", "น.ส. จิณห์นิภา ประสาทเขตรการ", "XXX-X-XX996-5", "ttb",
                  "รหัสอ้างอิง: 202508161903564508", "tb"),
             dict(sender_name=SENDER, sender_account=SENDER_ACC, receiver_name="น.ส. จิณห์นิภา ประสาทเขตรการ",
                  receiver_account="XXX-X-XX996-5", receiver_bank_code="TTB")),
    "month_alias": (slip("Utb", "to the the the tub tub tub to the", "b ttb ttb tub tab tab 15 W.A. 68, 16:00 u.", "ttb",
                         "100.00", "ค่าธรรมเนียม 0.00", SENDER, SENDER_ACC, "ttb", "นางสาว เปรมวดี ศรีราช", "XXXXXXXX5879",
                         "GSB", "รหัสอ้างอิง: 202505151502439098", "tub"),
                    dict(transaction_date="2025-05-15", transaction_time="16:00")),
    "date_from_reference": (slip("Utb", "100.00", SENDER, SENDER_ACC, "ttb", "นางสาว เปรมวดี ศรีราช", "XXXXXXXX5879", "GSB",
                                 "รหัสอ้างอิง: 202505151502439098", "tub"), dict(transaction_date="2025-05-15")),
    "bill_reference": (slip("Utb", "พอ พอ พอ พอ นอ จ่ายบิลสำเร็จ", "ttb", "16 W.A. 68, 18:13 U.", "40.00",
                            "ค่าธรรมเนียม 0.00", SENDER, SENDER_ACC, "ttb", "ร้านถุงเงิน (รัตนา กายดี)",
                            "(010753700088205)", "1836006037022605006", "thb thb RATANA",
                            "รหัสอ้างอิง: 202505161803449485", "Utb"), dict(amount=40.0)),
    "short_reference": (slip("Utb", "b ttb tub tab tab tab 21 LU.E. 69, 10:26 u.", "ttb", "60.00", "ค่าธรรมเนียม 0.00",
                             SENDER, SENDER_ACC, "ttb", "นางสาว วิภาวรรณ ชินอักษร", "XXX-XXX-8577", "พร้อมเพย์",
                             "รหัสอ้างอิง: 260421102630069281", "tb"),
                        dict(transaction_date="2026-04-21", transaction_time="10:26")),
    "decimal_first": (slip("Utb", "พระพร 5 5 5 โอนเงินสำเร็จ", "tub tub tub tub tub to 22 IU.E. 69, 17:06 u.", "2,800.00",
                           "AsssuluЯ 0.00 ttb ttb ttb ttb ttb t", SENDER, SENDER_ACC, "ttb", "นาย สุเมธ สุขเอม",
                           "XXXXXXXX0800", "GSB", "บันทึกช่วยจํา", "สมาชิกกองทุน",
                           "รหัสอ้างอิง: 260422170611488141 -5 thb tip tib titb", "Ub"),
                      dict(amount=2800.0, memo="สมาชิกกองทุน")),
    "noisy_sender": (slip("Ub", "29 LU.E. 69, 10:38 U.", "ttb ttb ttb to 115.00",
                          "p to thb thb tito น ค่าธรรมเนียม 0.00 to be title title title t",
                          "นาย ณัฐชัย รักษาวงษ์ เbe to tip to LED LED LED L", SENDER_ACC, "sommaiy pongngern ttb ttb",
                          "(010753600031501)", "KB000002200099", "รหัสอ้างอิง: 260429103811505892 ttb ttb"),
                     dict(sender_name=SENDER, receiver_name="sommaiy pongngern", receiver_bank_code=None, amount=115.0)),
    "self_transfer": (slip("Utb", "to the the the tub tub tub to the", "b ttb ttb ttb ttb tub 23 W.A. 68, 17:53 u.", "ttb",
                           "100.00", "ค่าธรรมเนียม 0.00", SENDER, SENDER_ACC, "ttb", SENDER, "XXX-X-XX452-9", "KTB",
                           "รหัสอ้างอิง: 202505231703091180", "tb"),
                      dict(sender_name=SENDER, sender_account=SENDER_ACC, receiver_name=SENDER,
                           receiver_account="XXX-X-XX452-9", receiver_bank_code="KTB")),
    "bill_merchant": (slip("Utb", "พอ พอ พอ พอ พอ จ่ายบิลสำเร็จ", "ttb", "7 มี.ค. 69, 22:24 น.", "72.00",
                           "ค่าธรรมเนียม 0.00", SENDER, SENDER_ACC, "ttb", "CJ 2044 Nong Pling Ruam Chai, Nakhon Sawan",
                           "(010753600031501)", "KB000002264689", "ttb ttb APIC17728970796149GC",
                           "รหัสอ้างอิง: 202603072203904235", "回", "Utb"),
                      dict(receiver_name="CJ 2044 Nong Pling Ruam Chai, Nakhon Sawan", receiver_bank_code=None)),
}
