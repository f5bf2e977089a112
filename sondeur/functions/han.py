"""Terms of Chinese texts: each Han character is a term, runs of other letters are words."""

from __future__ import annotations

#: Blocks of ideographs and of their compatibility forms, as ranges of code points.
_RANGES = ((0x3300, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0x20000, 0x2A6DF), (0x2A700, 0x2CEAF), (0x2F800, 0x2FA1F))
_MARKS = "·×…、《》『』【】"
#: Sentence ends: as in other texts, and fullwidth punctuation.
SENTENCE = "[.,;?!][\\s\x85\xa0\u2000-\u200a\u3000]+|[，。！？：（）“”]"
_HAN = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _RANGES)

#: Traditional characters and their simplified forms, pair by pair: common ones; `simplified` takes a larger table too.
_PAIRS = (
    "萬万與与專专業业東东絲丝兩两嚴严喪丧個个豐丰臨临為为麗丽舉举義义烏乌樂乐喬乔習习鄉乡書书買买亂乱爭争虧亏雲云亞亚產产畝亩親亲億亿僅仅從从侖仑倉仓儀仪們们價价眾众優优會会傘伞偉伟傳传傷伤倫伦偽伪體体餘余傭佣"
    "俠侠僥侥偵侦側侧僑侨債债傾倾償偿儲储兒儿黨党蘭兰關关興兴養养獸兽內内岡冈冊册寫写軍军農农馮冯決决況况凍冻淨净準准涼凉減减湊凑鳳凤憑凭凱凯擊击鑿凿劃划劉刘則则剛刚創创刪删別别劑剂劍剑劇剧勸劝辦办務务動动勵励勁劲勞劳"
    "勢势勳勋匯汇區区醫医華华協协單单賣卖盧卢衛卫卻却廠厂廳厅歷历厲厉壓压厭厌廁厕廈厦廚厨縣县參参雙双發发變变敘叙葉叶號号嘆叹嚇吓嗎吗啟启吳吴員员響响問问嘩哗喚唤嘗尝囑嘱園园圍围國国圖图圓圆聖圣場场壞坏塊块堅坚壇坛墳坟墜坠"
    "壘垒墾垦執执報报聲声殼壳處处備备複复夠够頭头夾夹奪夺奮奋獎奖奧奥妝妆婦妇媽妈嬌娇娛娱嬰婴孫孙學学寧宁寶宝實实寵宠審审憲宪宮宫寬宽賓宾對对尋寻導导壽寿將将爾尔塵尘堯尧屍尸盡尽層层屆届屬属嶼屿歲岁豈岂嶄崭島岛峽峡"
    "幣币帥帅師师帳帐簾帘帶带幫帮幹干並并廣广莊庄慶庆庫库應应廟庙廢废開开異异棄弃張张彌弥彎弯彈弹強强歸归當当錄录徹彻徑径禦御憶忆懺忏憂忧懷怀態态憐怜總总戀恋懇恳惡恶惱恼懸悬驚惊懼惧慘惨懲惩慣惯憤愤願愿懶懒戲戏戰战戶户"
    "撲扑擴扩掃扫揚扬擾扰撫抚拋抛搶抢護护擔担擬拟擁拥攔拦擇择掛挂撥拨揮挥撿捡換换損损據据搖摇攤摊擺摆攝摄敵敌數数齋斋鬥斗斬斩斷断無无舊旧時时曠旷晝昼顯显曉晓暫暂術术機机殺杀雜杂權权條条來来楊杨極极構构槍枪櫃柜標标"
    "棧栈棟栋樹树樣样橋桥檔档夢梦檢检樓楼橫横櫻樱歐欧歡欢歎叹殘残毀毁畢毕氣气漢汉湯汤溝沟滅灭滬沪淚泪澤泽潔洁灑洒淺浅測测濟济濃浓滿满潤润漲涨漸渐淵渊漁渔滲渗溫温灣湾濕湿濤涛潰溃滾滚滯滞濱滨瀏浏瀉泻燈灯靈灵災灾爐炉點点"
    "煉炼爛烂煙烟煩烦燒烧熱热愛爱爺爷牆墙狀状猶犹獨独獅狮獄狱獲获貓猫獻献環环現现瑪玛電电畫画暢畅療疗瘋疯痺痹癢痒癡痴監监蓋盖盤盘眾众睜睁瞭了矯矫礦矿碼码磚砖確确禮礼禍祸禪禅離离種种積积稱称穩稳窮穷竊窃競竞筆笔節节範范築筑"
    "簡简籃篮籌筹類类糧粮緊紧糾纠紀纪約约紅红紋纹納纳純纯紙纸級级紛纷細细紹绍終终組组結结絕绝絡络給给統统經经綠绿維维綱纲網网緒绪續续線线緣缘編编緩缓練练縮缩績绩織织繼继纖纤羅罗罰罚聞闻聯联聰聪職职肅肃腸肠膚肤脅胁腦脑腳脚膽胆臉脸"
    "臘腊艦舰艱艰藝艺蘇苏蘋苹薦荐藍蓝藥药蟲虫雖虽蝦虾螞蚂補补裝装襲袭見见規规視视覺觉覽览觀观觸触計计訂订認认討讨讓让訓训議议記记講讲許许論论設设訪访證证評评識识詞词詩诗試试話话詳详語语誤误說说請请課课調调談谈謀谋謂谓謝谢謹谨"
    "譜谱貝贝負负財财責责貢贡貧贫貨货販贩貪贪貴贵費费貿贸賀贺資资賦赋賞赏賢贤質质賽赛贈赠贊赞贏赢趙赵趕赶趨趋跡迹踐践踴踊車车軌轨軟软載载較较輕轻輛辆輝辉輩辈輪轮輯辑輸输轉转轟轰辭辞邊边遼辽達达遷迁過过運运還还這这進进遠远違违連连遲迟"
    "選选遺遗郵邮鄰邻醬酱釋释鑒鉴針针釣钓鈔钞鋼钢鐘钟鑰钥錢钱鐵铁鈴铃鉛铅銀银銅铜銷销鎖锁鋒锋錯错錶表鍵键鎮镇鏡镜長长門门閃闪閉闭閒闲間间閱阅闆板隊队陽阳陰阴陣阵階阶際际陸陆陳陈險险隨随隱隐雞鸡難难霧雾靜静韓韩頁页頂顶項项順顺須须頓顿預预"
    "領领頗颇頻频題题額额顏颜風风飛飞飯饭飲饮飾饰飽饱餅饼館馆饑饥馬马駕驾驗验騎骑騙骗髒脏魚鱼鮮鲜鯨鲸鳥鸟鳴鸣鴨鸭鵝鹅鷹鹰麥麦黃黄齊齐齒齿龍龙龜龟鬧闹麵面裡里後后臺台灣湾製制"
)


def table() -> dict[str, str]:
    return {_PAIRS[i]: _PAIRS[i + 1] for i in range(0, len(_PAIRS), 2)}


_TABLE = table()


def simplified(text: str) -> str:
    return "".join(_TABLE.get(c, c) for c in text)


def is_han(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in _RANGES)


def is_mark(c: str) -> bool:
    return c in _MARKS


#: Of a text whose rare separators are blanks: one ideograph, or what ends a word besides separators.
PIECE = f"[{_HAN}]|"
EXCLUDED = f"{_MARKS}{_HAN}"
